"""All queries of the memory engine by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from loomstead.plans import evaluation, lifecycle, measures, memory, shapes, streams  # noqa: F401  (they add their queries to the registry of memory)

FLAGSHIP = "j03_similarity_topk"


def queries() -> dict[str, Callable]:
    return dict(memory.QUERIES)


def oracles() -> dict[str, str]:
    return dict(memory.ORACLES)
