"""Streams and byte-wise folds as queries: the whole of a table is replayed, and what has settled is told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.plans.memory import ORACLES, query
from loomstead.plans.tables import DERIVED, derived
from loomstead.session import shared_dir
from loomstead.streaming import captures as C
from loomstead.streaming import reactions as L


def replayed(spark: SparkSession, sf_dir: str, name: str, end: str, time: str) -> DataFrame:
    """A derived table as a stream of its files, then of one row that is dated long after all others and lets them settle."""
    table, columns, where = DERIVED[name]
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        rows = source.parquet(f"{sf_dir}/{table}.parquet")
    else:  # a stream reads folders
        rows = source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    rows = rows.where(where).selectExpr(*columns)
    batch = derived(spark, sf_dir, name)
    nothing = [F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name) for f in batch.schema if f.name != time]
    batch.groupBy().agg(F.max(time).alias("t")).select(*nothing, (F.col("t") + F.expr("INTERVAL 30 DAYS")).cast(batch.schema[time].dataType).alias(time)).write.parquet(end)
    return rows.unionByName(spark.readStream.schema(spark.read.parquet(end).schema).parquet(end))


@query("st11_late_reactions")
def _(spark, sf_dir):
    """Reactions and captures as two streams; the same picks as the join of the tables."""
    at = shared_dir(spark)
    reactions = replayed(spark, sf_dir, "reactions", f"{at}/r", "ts")
    captures = replayed(spark, sf_dir, "captures", f"{at}/c", "created_at")
    L.run_attachments(reactions, captures, f"{at}/sink", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/sink").where("message_id <> ''").select("message_id", "capture_id")


ORACLES["st11_late_reactions"] = ORACLES["j04_asof_reactions"]


def _log(turns: DataFrame) -> DataFrame:
    """Turns as segments of few long logs, some without a time that can be read."""
    iso = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    said = F.concat(F.lit("## "), iso, F.lit(" "), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return turns.select(
        F.concat(F.lit("p"), (F.col("conv_id") % 4).cast("string")).alias("project"), F.concat(F.substring(iso, 1, 10), F.lit(".md")).alias("file"),
        (F.col("conv_id") * 4096 + F.col("turn")).alias("start"), F.when(F.col("turn") % 5 == 4, "no time").otherwise(iso).alias("iso"), said.cast("binary").alias("content"),
    )


@query("w08_byte_chunks", "turns")
def _(turns):
    """Whole turns up to 4,096 bytes a chunk; a turn that alone is longer is split."""
    parts = C.chunked(_log(turns), budget=4096)
    return parts.select("project", "chunk", "file", "start", "end", "iso", "header", "split", F.md5("content").alias("digest"))


@query("st3_chunks", "turns")
def _(turns):
    told = C.chunks(C.chunked(_log(turns), budget=4096))
    return told.select("project", "chunk", "turns", "bytes", "covers_from", "covers_until", "boundary", F.sha2("text", 256).alias("digest"))


@query("st4_watermarks", "turns")
def _(turns):
    """The latest time told after each chunk never goes back."""
    return C.watermarks(C.chunked(_log(turns), budget=4096)).select("project", "chunk", "watermark")


@query("f46_split_points")
def _(spark, sf_dir):
    """Pieces of at most 4,096 bytes, cut after a line's end or before a character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return C.split_texts(docs, 4096).select("doc_id", "place", "start", F.octet_length("piece").cast("bigint").alias("bytes"), F.md5("piece").alias("digest"))
