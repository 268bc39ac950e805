"""Writing facts one after another: each sees what those before it did.

A fact only depends on facts and stored points that are alike enough to it,
on what those depend on, and on those with its hash.  So rows are first
gathered into components of that relation: blocks of vectors of one arm (user,
lane, persona) meet as matrix products, each of which tells a spanning set of
links, never all pairs.  Then each component is folded in order, in sorted
partitions, holding only the points that were added.  A hot arm falls into as
many components as it has unlike facts; one component is one order of
decisions and stays in one task, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators.components import connected_components
from loomstead.operators.recall import SALTS, arm_blocks, not_superseded
from loomstead.operators.writes import BAND_CEILING, DEDUP_THRESHOLD, JUDGE_CONFIDENCE
from loomstead.session import written

ARM = ("user_id", "lane", "persona")
DIGITS = 12  # scores are compared to so many places, so that equal vectors tie whatever the order of their sums


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pair of blocks, links that connect what similarity connects."""
        for batch in batches:
            for r in batch.to_pylist():
                q, p = np.array(r["q_ids"]), np.array(r["p_ids"])
                alike = np.frombuffer(r["q_v"]).reshape(len(q), -1) @ np.frombuffer(r["p_v"]).reshape(len(p), -1).T >= least
                alike &= q[:, None] != p[None]
                q_least, p_least, far = q.copy(), p.copy(), np.iinfo(np.int64).max
                while True:
                    q_next = np.minimum(q_least, np.where(alike, p_least[None], far).min(1))
                    p_next = np.minimum(p_least, np.where(alike, q_next[:, None], far).min(0))
                    if (q_next == q_least).all() and (p_next == p_least).all():
                        break
                    q_least, p_least = q_next, p_next
                src, dst = np.concatenate([q, p]), np.concatenate([q_least, p_least])
                yield pa.RecordBatch.from_arrays([pa.array(src[src != dst]), pa.array(dst[src != dst])], ["src", "dst"])

    return run


def similarity_links(points: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """``src``, ``dst``: links that join every fact to each point of its arm that is at least ``least`` alike, through others or directly."""
    q, p = arm_blocks(facts, "q", ARM), arm_blocks(points, "p", ARM)
    p = p.withColumn("salt", F.pmod(F.xxhash64("p_ids"), F.lit(SALTS)))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    met = q.join(p, ["arm", "salt"]).select("q_ids", "q_v", "p_ids", "p_v")
    return met.mapInArrow(_links(least - 10.0**-DIGITS), "src bigint, dst bigint").distinct()


class Fold:
    """The points of one component that may take a fact in, as they stand."""

    def __init__(self) -> None:
        self.seq: list[int] = []
        self.hash: list[str | None] = []
        self.current: list[bool] = []
        self.by_hash: dict[str, list[int]] = {}
        self.vectors = np.zeros((0, 0))
        self.slot: list[int] = []  # the point of each row of vectors

    def add(self, seq: int, hash_: str | None, vector: np.ndarray | None) -> None:
        at = len(self.seq)
        self.seq.append(seq)
        self.hash.append(hash_)
        self.current.append(True)
        if hash_ is not None:
            self.by_hash.setdefault(hash_, []).append(at)
        if vector is not None:
            if len(self.slot) == len(self.vectors):
                room = np.zeros((max(8, 2 * len(self.vectors)), len(vector)))
                if self.slot:
                    room[: len(self.slot)] = self.vectors[: len(self.slot)]
                self.vectors = room
            self.vectors[len(self.slot)] = vector
            self.slot.append(at)

    def drop(self, at: int) -> None:
        """A superseded point leaves the candidates at once."""
        self.current[at] = False
        if self.hash[at] is not None:
            self.by_hash[self.hash[at]].remove(at)
        gone = self.slot.index(at)
        self.vectors[gone : len(self.slot) - 1] = self.vectors[gone + 1 : len(self.slot)].copy()
        del self.slot[gone]

    def same(self, hash_: str | None) -> int | None:
        held = self.by_hash.get(hash_, []) if hash_ is not None else []
        return min(held, key=self.seq.__getitem__) if held else None

    def nearest(self, vector: np.ndarray | None, least: float) -> tuple[int, float] | None:
        if vector is None or not self.slot:
            return None
        scores = np.round(self.vectors[: len(self.slot)] @ vector, DIGITS)
        top = scores.max()
        if top < least:
            return None
        return min((self.slot[i] for i in np.flatnonzero(scores == top)), key=self.seq.__getitem__), float(top)

    def write(self, fact: dict, vector: np.ndarray | None, least: float, ceiling: float) -> tuple[str, int | None]:
        """What becomes of a fact, and the point concerned."""
        if (held := self.same(fact["hash"])) is not None:
            return "DEDUP_MERGED", self.seq[held]
        event, target = "ADD", None
        if found := self.nearest(vector, least):
            at, score = found
            sure = fact["contradicts"] and (fact["confidence"] or 0.0) >= JUDGE_CONFIDENCE
            target = self.seq[at]
            if not (fact["parted"] and least <= score <= ceiling and sure):
                return "DEDUP_MERGED", target
            event = "SUPERSEDED_INBAND"
            self.drop(at)
        self.add(fact["seq"], fact["hash"], vector)
        return event, target


def unit(values: list[float] | None) -> np.ndarray | None:
    if not values:
        return None
    v = np.array(values, np.float64)
    norm = np.linalg.norm(v)
    return v / norm if norm > 0 else v


def _folded(least: float, ceiling: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components one after another, from rows sorted by component, stored points first, then facts by seq."""
        here, state = None, Fold()
        for batch in batches:
            out: list[tuple[int, str, int | None]] = []
            for r in batch.to_pylist():
                if r["component"] != here:
                    here, state = r["component"], Fold()
                vector = unit(r["vector"])
                if r["fact"]:
                    out.append((r["seq"], *state.write(r, vector, least, ceiling)))
                else:
                    state.add(r["seq"], r["hash"], vector)
            seq, event, target = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(event, pa.string()), pa.array(target, pa.int64())], ["seq", "event", "target"])

    return run


def add_in_order(facts: DataFrame, store: DataFrame, *, least: float = DEDUP_THRESHOLD, ceiling: float = BAND_CEILING) -> DataFrame:
    """``seq``, ``event`` and ``target`` of each fact, written in order of ``seq`` to ``store``.

    A fact with the hash of a current point of its arm is merged into it (the
    least seq of several); else into the nearest current point that is at
    least ``least`` alike, unless it contradicts that one within the band: then
    the older leaves and the fact is added; else it is added.  Points that were
    added or superseded by earlier facts count as they stand then.

    ``facts`` need seq (unlike all others), user_id, lane, persona, hash,
    vector, contradicts and confidence; ``store`` the first six and status.
    Defined results: absent lanes and personas are a part of their own; a null
    hash or vector matches nothing; vectors of length zero are alike to none;
    no facts give no rows; other columns are ignored.
    """
    keys = ["seq", *ARM, "hash", "vector"]
    parted = (F.coalesce("lane", F.lit("")) != "") | (F.coalesce("persona", F.lit("")) != "")
    new = facts.select(*keys, F.lit(True).alias("fact"), "contradicts", F.col("confidence").cast("double").alias("confidence"), parted.alias("parted"))
    old = store.where(not_superseded()).select(*keys, F.lit(False).alias("fact"), F.lit(False).alias("contradicts"), F.lit(0.0).alias("confidence"), F.lit(False).alias("parted"))
    rows = written(new.union(old))
    first = rows.where("hash IS NOT NULL").groupBy(*ARM, "hash").agg(F.min("seq").alias("dst"), F.max("fact").alias("any"), F.count("*").alias("n")).where("any AND n > 1")
    alike = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*ARM, "hash")]
    same = rows.alias("r").join(first.alias("f"), alike[0] & alike[1] & alike[2] & alike[3]).select(F.col("r.seq").alias("src"), "dst")
    links = same.union(similarity_links(rows, rows.where("fact"), least))
    parts = connected_components(links)
    placed = rows.join(parts.withColumnRenamed("node", "seq"), "seq", "left")
    alone = placed.where("fact AND component IS NULL").select("seq", F.lit("ADD").alias("event"), F.lit(None).cast("bigint").alias("target"))
    held = placed.where("component IS NOT NULL").select("component", "seq", "fact", "hash", "vector", "contradicts", "confidence", "parted")
    folded = held.repartition("component").sortWithinPartitions("component", "fact", "seq").mapInArrow(_folded(least, ceiling), "seq bigint, event string, target bigint")
    return alone.union(folded)


def store_after(store: DataFrame, facts: DataFrame, told: DataFrame) -> DataFrame:
    """``seq``, ``status``, ``superseded_by`` and ``merged`` (how many facts it took in) of each point once ``told`` has been written."""
    by = told.where("event = 'SUPERSEDED_INBAND'").select(F.col("target").alias("seq"), F.col("seq").alias("by"))
    took = told.where("event = 'DEDUP_MERGED'").groupBy(F.col("target").alias("seq")).agg(F.count("*").alias("merged"))
    added = told.where("event <> 'DEDUP_MERGED'").select("seq", F.lit("current").alias("status"))
    points = store.select("seq", "status").union(added).join(by, "seq", "left").join(took, "seq", "left")
    return points.select("seq", F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), F.col("by").alias("superseded_by"), F.coalesce("merged", F.lit(0)).alias("merged"))
