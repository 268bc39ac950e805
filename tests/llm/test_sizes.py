"""What larger tables need: joins whose sides don't pass the driver."""

from pyspark.sql import functions as F

from loomstead.llm import surrogates


def test_entities_are_not_broadcast(spark):
    """One address that 700 rows mention, and 300 of one row each."""
    mail = F.when(F.col("doc_id") < 700, F.lit("one.person@mail.example.com")).otherwise(F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("@mail.example.com")))
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to "), mail, F.lit(" soon")).alias("text"))
    made = surrogates.replace_private(docs)
    joins = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [kind#" in x]
    assert any("SortMergeJoin" in x for x in joins) and not [x for x in joins if "BroadcastHashJoin" in x and "LeftOuter" not in x]
    rows = made.collect()
    texts = [r.text for r in rows]
    assert len(rows) == 1000 and all(r.n_entities == 1 for r in rows) and not any("one.person" in t for t in texts)
    assert len(set(texts)) == 301 and max(map(texts.count, set(texts))) == 700
