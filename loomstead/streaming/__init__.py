"""Structured Streaming jobs of the memory engine."""
