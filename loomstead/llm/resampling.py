"""Importance resampling toward a target distribution, in two Arrow passes.

Features are runs of consecutive words; each falls into one of ``BUCKETS``
buckets by its crc32.  The first pass counts, per partition, the buckets of
raw and of target texts (one vector of fixed length a partition), and a tree
of sums merges the vectors.  The log ratio of the smoothed shares is a
bucket's gain.  The second pass takes the broadcast gains (one vector) and
sums them by document; Gumbel noise keyed by the document's id turns the
``percent`` highest scores into a sample without replacement.

Ranks are global, but no task sees all rows: scores are integers within a fixed
range, so their histogram tells the lowest score that is drawn, and only rows
from there on are dealt into sorted ranges.

Defined results: null and empty texts have no features and weight 0; a
document of fewer than ``least_words`` words is scored but never drawn;
repeated rows are documents of their own and tie; of ties the smaller id is
drawn first, null last; a null id is hashed as an empty one; no rows, or none
long enough, draw nothing; an empty target gives the gains of its smoothing
alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.retrieval import global_rank
from loomstead.session import written

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024

# Capitals become small letters; what is no word, a space. Bytes from 0x80 on belong to words, whatever the character.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def features(found: list[bytes], longest: int) -> list[bytes]:
    """Runs of 1 to ``longest`` consecutive words."""
    out = list(found)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*(found[i:] for i in range(n)), strict=False))
    return out


def buckets(runs: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % n


def bucket_counts(texts: DataFrame, text_col: str = "text", *, n_buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (value := text.as_buffer()) is not None:
                    total += np.bincount(buckets(features(words(value.to_pybytes()), longest), n_buckets), minlength=n_buckets)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    vectors = texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "v binary").rdd.map(lambda r: np.frombuffer(bytes(r.v), np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(n_buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    ratio = [float(b + 1) * (s + n) / (float(a + 1) * (t + n)) for a, b in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _noise(ids: list, seed: int) -> np.ndarray:
    heads = [int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) for i in ids]
    return np.floor(-1000 * np.log(-np.log((np.array(heads, float) + 0.5) / 4294967296))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            n_words, sizes, found, sums, held = [], [], [], [], 0
            for text in batch.column(1):
                value = text.as_buffer()
                w = words(value.to_pybytes()) if value is not None else []
                runs = features(w, longest)
                n_words.append(len(w))
                sizes.append(len(runs))
                found.append(buckets(runs, len(gain)))
                held += len(runs)
                if held > 1 << 20:  # documents of so many features at a time
                    sums.append(_sums(gain, sizes[-len(found) :], found))
                    found, held = [], 0
            if found:
                sums.append(_sums(gain, sizes[-len(found) :], found))
            n = np.array(sizes, np.int64)
            total = np.concatenate(sums) if sums else np.zeros(0, np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            score = weight + _noise(batch.column(0).to_pylist(), seed) if len(n) else weight
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def _sums(gain: np.ndarray, sizes: list[int], found: list[np.ndarray]) -> np.ndarray:
    """Sum of gains of each document: whole numbers, exact in doubles."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(owner, weights=gain[np.concatenate(found)], minlength=len(sizes)).astype(np.int64)


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS,
    n_buckets: int = BUCKETS, longest: int = 1, seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of each document; the rank is null where it is not drawn."""
    kind = {"n_buckets": n_buckets, "longest": longest}
    gain = gains(bucket_counts(docs, text_col, **kind), bucket_counts(target, text_col, **kind))
    rows = written(scored(docs, gain, id_col=id_col, text_col=text_col, longest=longest, seed=seed))
    able = F.col("n_words") >= least_words
    steps = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a score, whatever the rows
    drawn = F.floor(F.lit(percent) * F.sum("n").over(Window.partitionBy()) / 100)
    drawn, cut = steps.select(above.alias("above"), drawn.alias("k"), "score").where("above < k").agg(F.max("k"), F.min("score")).first()
    if not drawn:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    near = able & (F.col("score") >= cut)
    ranks = global_rank(rows.where(near), F.desc("score"), F.asc_nulls_last("doc_id"))
    kept = ["doc_id", "n_features", "weight", "score"]
    ranks = ranks.select(*kept, F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank"))
    return ranks.union(rows.where(~near).select(*kept, F.lit(None).cast("bigint")))
