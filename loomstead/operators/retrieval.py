"""Lexical retrieval, rank fusion and retrieval metrics."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomstead.functions.text import ngrams
from loomstead.session import written

K1, B, RRF_K = 1.2, 0.75, 60  # fixed values of the scoring formulas


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, 2 to 30 long."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w).between(2, 30))


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``term``, ``tf``, ``dl``."""
    t = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """The ``k`` best documents for the distinct ``terms``, by statistics of the whole corpus.

    Terms are filtered before the shuffle; corpus size and mean length come
    from one aggregate over token counts.
    """
    counted = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    whole = counted.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("mean"))
    hit = counted.select("doc_id", F.size("t").alias("dl"), F.explode(F.filter("t", lambda w: w.isin(*set(terms)))).alias("term"))
    tf = hit.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # one row a term, one row in all
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return s.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def match_all(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold every term."""
    t = tokens(F.col("text"))
    hold = F.lit(True)
    for term in sorted(set(terms)):
        hold = hold & F.array_contains(t, term)
    return docs.where(hold).select("doc_id")


def global_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """``rank`` of every row from 1: rows are dealt into sorted ranges, and each range adds the sizes of those before it."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_in", inside).join(parts, "_part").withColumn("rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def fuse(arms: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (doc_id, rank) arms with weights; weight 0 is skipped."""
    parts = [a.select("doc_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for a, w in arms if w]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("doc_id").agg(F.round(F.sum("s"), 9).alias("score"))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "k")))


def metrics(rows: DataFrame, k: int = 5) -> DataFrame:
    """Per query: whether a target is in the top ``k``, reciprocal rank and nDCG."""
    r = ranked(rows)
    gain = F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = r.groupBy("qid").agg(
        F.max((F.col("relevant") & (F.col("rank") <= k)).cast("int")).alias("hit"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"), F.sum(F.col("relevant").cast("int")).alias("targets"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("targets").cast("int"), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("qid", "hit", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.when(F.col("targets") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid, half, whole = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / whole, (mid + half) / whole


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    down = b * precision + recall
    return F.when(down > 0, (1 + b) * precision * recall / down).otherwise(0.0)


def threshold_sweep(rows: DataFrame, steps: int = 20) -> DataFrame:
    """Recall, precision and cost (5 for a false merge, 1 for a miss) at each threshold.

    Scores are first counted by step, so the sweep is a running sum over the
    steps, not a join of rows with thresholds.
    """
    step = F.floor(F.least(F.col("score"), F.lit(0.999999)) * steps).cast("int")
    cells = rows.groupBy(step.alias("step")).agg(F.sum(F.col("relevant").cast("bigint")).alias("pos"), F.sum((~F.col("relevant")).cast("bigint")).alias("neg"))
    up = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``steps`` rows
    every = Window.partitionBy()
    s = cells.select("step", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(every).alias("all"))
    return s.select(
        (F.col("step") / steps).alias("threshold"), F.round(F.col("tp") / F.col("all"), 6).alias("recall"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), (5 * F.col("fp") + F.col("all") - F.col("tp")).alias("cost"),
    )


WORD = re.compile("[a-z0-9_]+")
FILTER_BITS = 25  # fixed value: the largest filter has 4 MB


def _gram_codes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, list[str], list[int]]:
    """A number for each run of ``n`` words of the texts (in lower case), the place of its first word among all words, the words, and where each text ends among them."""
    words, ends = [], []
    for t in texts:
        words += WORD.findall(t or "")
        ends.append(len(words))
    known = pa.array(words, pa.string()).dictionary_encode()
    each = np.array([zlib.crc32(w.encode()) for w in known.dictionary.to_pylist()], np.uint64)[known.indices.to_numpy()] if words else np.zeros(0, np.uint64)
    last = np.repeat(ends, np.diff([0, *ends]))  # where the text of each word ends
    at = np.flatnonzero(np.arange(len(words)) + n <= last)
    code = np.zeros(len(at), np.uint64)
    for i in range(n):
        code = (code ^ each[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code * np.uint64(0xBF58476D1CE4E5B9), at, words, ends


def shared_grams(docs: DataFrame, others: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id`` and the number ``shared`` of distinct runs of ``n`` words that a document (doc_id, text) has in common with any of
    ``others`` (text), where there are some.

    A filter of at most 4 MB tells most runs that none of ``others`` has where the documents are read; those left are
    compared by their words, so the filter decides nothing.
    """
    spark = docs.sparkSession
    grams = written(others.select(F.explode(ngrams(F.col("text"), n)).alias("gram")).distinct())
    bits = min(FILTER_BITS, max(10, (16 * grams.count()).bit_length()))
    shift = np.uint64(64 - bits)

    def slots(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_gram_codes(b.column(0).to_pylist(), n)[0] >> shift).astype(np.int64))], ["slot"])

    lines = grams.mapInArrow(slots, "slot bigint").groupBy(F.shiftright("slot", 5).alias("line")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 31 AS INT))")).alias("held"))
    filled = np.zeros(1 << bits - 5, np.uint32)
    for r in lines.toLocalIterator():  # at most 2^20
        filled[r.line] = r.held
    shared = spark.sparkContext.broadcast(filled)

    def candidates(batches):
        held = shared.value
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            for start in range(0, len(texts), 256):
                part = texts[start : start + 256]
                code, at, words, ends = _gram_codes(part, n)
                slot = code >> shift
                at = at[(held[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0]
                if len(at):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(start + np.searchsorted(ends, at, "right"))), pa.array([" ".join(words[i : i + n]) for i in at.tolist()], pa.string())], ["doc_id", "gram"])

    schema = StructType([docs.schema["doc_id"], StructField("gram", StringType())])
    found = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(candidates, schema)
    return found.join(grams, "gram").groupBy("doc_id").agg(F.countDistinct("gram").alias("shared"))
