"""Reads: scans, filters, projections, listings and searches over memory points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM_DOC = "_embedding_stamp"  # fixed value: id of the hidden stamp
GONE = ("superseded", "deprecated", "rejected")  # fixed value: states that are not recalled
SNIPPET = 240
LIST_LIMIT, MAX_LIMIT, FULL_SCAN = 100, 100, 10_000
BLOCK = 2048
SALTS = 16


def recallable() -> Column:
    """Not superseded, deprecated, rejected or invalidated; without a status, a point is current."""
    return ~F.coalesce(F.col("status").isin(*GONE), F.lit(False)) & F.col("invalidated_at").isNull()


def not_superseded() -> Column:
    return ~F.col("status").eqNullSafe("superseded")


def not_system() -> Column:
    return ~F.col("doc_id").eqNullSafe(SYSTEM_DOC)


def same_arm(name: str, value: str | None) -> Column:
    """Equal, or both absent."""
    return F.col(name).eqNullSafe(F.lit(value))


def scoped_scan(points: DataFrame, user_id: str, limit: int = LIST_LIMIT) -> DataFrame:
    return points.where(F.col("user_id") == user_id).orderBy("seq").limit(limit)


def assert_unsaturated(points: DataFrame, bound: int = FULL_SCAN) -> DataFrame:
    """The rows, unless there are ``bound`` or more: then an error, before anything is deleted."""
    if points.limit(bound).count() >= bound:
        raise ValueError(f"scan reached {bound} rows; refusing to act on a part")
    return points


def project_point(points: DataFrame, reserved: tuple[str, ...] = ("id", "data", "hash")) -> DataFrame:
    """Reserved fields at the top, the rest as a map without nulls."""
    rest = [c for c in points.columns if c not in reserved and c not in ("vector", "seq")]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    return points.select(*reserved, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metadata"))


def coerce_limit(value, default: int | None = None) -> int | None:
    """Finite and above 0, at most MAX_LIMIT; else the default."""
    try:
        n = float(value)
    except (TypeError, ValueError):
        return default
    return min(int(n), MAX_LIMIT) if 0 < n < float("inf") else default


def snippet(title: Column, body: Column, n: int = SNIPPET) -> Column:
    """``title — body``, the body cut to ``n`` code points with an ellipsis."""
    trimmed = F.trim(F.coalesce(body, F.lit("")))
    cut = F.when(F.length(trimmed) > n, F.concat(F.substring(trimmed, 1, n), F.lit("…"))).otherwise(trimmed)
    return F.when(F.coalesce(title, F.lit("")) == "", cut).otherwise(F.concat_ws(" — ", title, cut))


def compact(points: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif("title", F.lit("")), "doc_id", F.lit("(untitled)"))
    return points.select(F.coalesce("doc_id", "id").alias("id"), title.alias("title"), snippet(title, F.col("data")).alias("snippet"))


def superseded_listing(points: DataFrame, *, lane: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    found = points.where("status = 'superseded'")
    if lane is not None:
        found = found.where(F.col("lane") == lane)
    return found.orderBy(F.col("superseded_at").desc_nulls_last(), "id").offset(offset).limit(limit)


def parse_filters(filters: dict) -> Column:
    """A condition from a flat dict, or {"AND": [flat, ...]}, or {"OR": [flat, ...]}; other shapes are errors."""
    keys = {"user_id", "agent_id", "app_id", "run_id", "lane", "project"}

    def flat(one: dict) -> Column | None:
        out = None
        for k, v in one.items():
            if k == "created_at" and isinstance(v, dict) and set(v) <= {"gte", "lte"}:
                at = F.try_to_timestamp(F.col("created_at").cast("string"))
                conds = [at >= F.try_to_timestamp(F.lit(v["gte"]))] * ("gte" in v) + [at <= F.try_to_timestamp(F.lit(v["lte"]))] * ("lte" in v)
            elif k == "categories" and isinstance(v, dict) and set(v) == {"contains"}:
                conds = [F.array_contains("categories", v["contains"])]
            elif k in keys and not isinstance(v, (dict, list)):
                conds = [F.col(k) == v]
            else:
                raise ValueError(f"unknown filter {k!r}")
            for c in conds:
                c = F.coalesce(c, F.lit(False))
                out = c if out is None else out & c
        return out

    for op in ("AND", "OR"):
        if op in filters:
            if set(filters) != {op}:
                raise ValueError(f"{op} stands alone")
            parts = [c for c in map(flat, filters[op]) if c is not None]
            if not parts:
                return F.lit(True)
            out = parts[0]
            for c in parts[1:]:
                out = out & c if op == "AND" else out | c
            return out
    return flat(filters) if filters else F.lit(True)


# ---- Similarity -------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a norm is 0."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = double(a), double(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def cosine_strict(a: Column, b: Column) -> Column:
    wrong = (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(wrong, F.raise_error(F.lit("vectors differ in length"))).otherwise(cosine(a, b))


def _blocked(seed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of unit vectors of one arm, from rows sorted by arm and then seq."""
        for batch in batches:
            arm = np.array(batch.column(1).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(arm[1:] != arm[:-1]) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts, cuts[1:], strict=False):
                for at in range(first, last, BLOCK):
                    some = batch.slice(at, min(BLOCK, last - at)).to_pydict()
                    ok = [i for i, v in enumerate(some["vector"]) if v]
                    v = np.array([some["vector"][i] for i in ok], np.float64)
                    if len(ok):
                        norm = np.linalg.norm(v, axis=1, keepdims=True)
                        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([some["arm"][0]]), pa.array([[some["seq"][i] for i in ok]], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())],
                            names=["arm", f"{seed}_ids", f"{seed}_v"],
                        )

    return run


def _scored(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best ``k`` of a block of points for each query of a block; of equal scores the least seq comes first, as blocks are sorted by it."""
        for batch in batches:
            for r in batch.to_pylist():
                q, p = np.array(r["q_ids"]), np.array(r["p_ids"])
                s = np.frombuffer(r["q_v"]).reshape(len(q), -1) @ np.frombuffer(r["p_v"]).reshape(len(p), -1).T
                s = np.where((q[:, None] != p[None]) & (s >= least), s, -np.inf)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows, cols = np.nonzero(np.take_along_axis(s, top, 1) > -np.inf)
                at = top[rows, cols]
                yield pa.RecordBatch.from_arrays([pa.array(q[rows], pa.int64()), pa.array(p[at], pa.int64()), pa.array(s[rows, at])], names=["query", "seq", "score"])

    return run


def arm_blocks(rows: DataFrame, seed: str, arms: tuple[str, ...]) -> DataFrame:
    """Blocks of unit vectors (``arm``, ``<seed>_ids``, ``<seed>_v``) of rows whose ``arms`` are equal or absent alike."""
    arm = F.concat_ws("\u0001", F.lit(""), *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in arms)).alias("arm")
    return rows.select("seq", arm, "vector").sortWithinPartitions("arm", "seq").mapInArrow(_blocked(seed), f"arm string, {seed}_ids array<bigint>, {seed}_v binary")


def nearest(points: DataFrame, queries: DataFrame, k: int, *, arms: tuple[str, ...] = (), least: float = -1.0) -> DataFrame:
    """``query``, ``seq``, ``score``, ``rank``: the ``k`` nearest points by cosine for each query row, itself excepted.

    Blocks of queries meet blocks of points of their own arm; a pair of blocks
    is one matrix product that yields ``k`` rows a query, which a ranked window
    then thins.  ``arms`` are columns that must be equal or both absent.  An
    arm's blocks of points are dealt over ``SALTS`` keys, so a hot arm is not one task.
    """
    p = arm_blocks(points, "p", arms).withColumn("salt", F.pmod(F.xxhash64("p_ids"), F.lit(SALTS)))
    q = arm_blocks(queries, "q", arms).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    near = q.join(p, ["arm", "salt"]).select("q_ids", "q_v", "p_ids", "p_v").mapInArrow(_scored(k, least), "query bigint, seq bigint, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "seq")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(points: DataFrame, query: list[float], *, k: int = 100) -> DataFrame:
    """The ``k`` points nearest to one vector: a top-k, never a full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return points.withColumn("score", cosine(F.col("vector"), q)).orderBy(F.col("score").desc(), "seq").limit(k)


# ---- Temporal ranking -------------------------------------------------------

FUTURE_TOLERANCE_MS = 5 * 60_000
UNDATED_FACTOR, FLOOR = 0.25, 0.05


def epoch_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def falloff_days(start_ms: int, end_ms: int) -> float:
    return min(30.0, max(1.0, (end_ms - start_ms) / 86_400_000 * 0.5))


def falloff(span_ms: Column) -> Column:
    """The same for a column of widths."""
    return F.least(F.lit(30.0), F.greatest(F.lit(1.0), span_ms / 86_400_000 * 0.5))


def in_window(at: Column, start_ms: int, end_ms: int, now_anchored: bool = False) -> Column:
    return F.coalesce(at.between(start_ms, end_ms + (FUTURE_TOLERANCE_MS if now_anchored else 0)), F.lit(False))


def temporal_decay(points: DataFrame, now_ms: int, half_life: float = 30.0) -> DataFrame:
    """Dated points fade with age; undated, scored ones by a constant; the order of ties stays."""
    at = epoch_ms(F.col("valid_from"))
    age = (F.lit(now_ms) - at) / 86_400_000.0
    dated = F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("score")) * F.least(F.lit(1.0), F.exp(-age / half_life))
    score = F.when(at.isNotNull(), dated).when(F.col("score").isNotNull(), F.col("score") * float(np.exp(-UNDATED_FACTOR)))
    return points.withColumn("decayed", score)


def temporal_window(points: DataFrame, start_ms: int, end_ms: int, undated: float = 0.8) -> DataFrame:
    """Points outside the window fade with their distance from it; nothing changes if none is inside."""
    at, fall = epoch_ms(F.col("valid_from")), falloff_days(start_ms, end_ms)
    inside = in_window(at, start_ms, end_ms)
    any_inside = points.where(inside).limit(1).count() > 0
    if not any_inside:
        return points.withColumn("windowed", F.col("score"))
    edge = F.when(at < start_ms, F.lit(start_ms) - at).otherwise(at - F.lit(end_ms)) / 86_400_000.0
    score = F.when(at.isNull(), F.col("score") * undated).when(inside, F.col("score")).otherwise(F.col("score") * F.greatest(F.exp(-edge / fall), F.lit(FLOOR)))
    return points.withColumn("windowed", score)
