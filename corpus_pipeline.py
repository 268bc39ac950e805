"""A training corpus in five stages, each an operator of ``loomstead.llm`` over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each
result as Parquet into the shared folder and reads it again for the next.
A document is known by its id: where rows repeat an id, they stay or go
together, and rows without an id are judged but never removed by a stage that
names ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm import decontaminate, mixing, ngram_join, token_shards, toxicity
from loomstead.session import ship, written

#: No stage's rows but the last's can be told by SQL, and these depend on a trained model.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    learn_from = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    fitted = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), learn_from=learn_from)
    if fitted is None:
        return docs
    columns = docs.columns
    return docs.withColumn("_score", fitted[0](F.col("text").cast("string"))).where("_score < 0.5").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of the n-gram Jaccard join (five words, 0.8)."""
    ship(spark)
    found = ngram_join.ngram_components(docs, width=5, percent=80)
    losers = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    times = mixing.mix(docs).where("taken > 0").groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    taken = docs.alias("d").join(times.withColumnRenamed("doc_id", "_id"), F.col("d.doc_id").eqNullSafe(F.col("_id")))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_copy")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids in the compressed shards."""
    import public_tokenizers

    ship(spark)
    return token_shards.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
