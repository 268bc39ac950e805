"""Sources and sinks: markdown vaults, JSON lines, counter and point tables."""
