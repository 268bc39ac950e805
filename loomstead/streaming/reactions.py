"""Late reactions as a stream: each waits for its capture until the day after it has passed.

Reactions and captures are two streams; the watermark is the earlier one of
theirs.  A batch takes up the rows that the one before left open, tells the
reactions that no capture still to come can reach, each once, and leaves open
the other reactions and the captures within their reach.  What is open lies in
Parquet files below the checkpoint, a folder a batch, so a batch that is run
again begins from the same rows.  Reactions find their captures in order of
time (``attribution.attach_reactions``), so no pairs are made.  A reaction that
meets none is told with a null capture.

Defined results: rows with a null user meet nothing; a reaction without a time
never comes out (it can't be placed); repeated reactions (same message, user
and time) are told once; captures later than the watermark are not looked at;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.operators.attribution import FORWARD_S, SKEW_S, attach_reactions, micros
from loomstead.streaming.commit import Store


def _rows(reactions: DataFrame, captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with times in microseconds; rows without a time are left out."""
    hashed = "hash" in reactions.columns and "hashes" in captures.columns
    text = F.lit(None).cast("string")
    r = reactions.select("message_id", "user_id", "run_id", micros("ts").alias("at"), (F.col("hash") if hashed else text).alias("hash"))
    c = captures.select("capture_id", "user_id", "run_id", micros("created_at").alias("at"), (F.col("hashes") if hashed else F.array(text)).alias("hashes"))
    return r.where("at IS NOT NULL"), c.where("at IS NOT NULL")


def _told(r: DataFrame, c: DataFrame) -> DataFrame:
    return attach_reactions(r, c).select("message_id", "user_id", F.timestamp_micros("at").alias("ts"), "capture_id")


def attach_late(reactions: DataFrame, captures: DataFrame) -> DataFrame:
    """``message_id``, ``user_id``, ``ts`` and ``capture_id`` of each reaction, from tables.

    Captures of the reaction's own run come before those without a run; of one
    tier, one whose ``hashes`` hold the reaction's ``hash`` (the earliest such)
    comes first, then the earliest at or after the reaction, then the latest
    before it.  ``hash`` and ``hashes`` are optional.
    """
    return _told(*_rows(reactions, captures))


def run_attachments(reactions: DataFrame, captures: DataFrame, sink: str, checkpoint: str, *, late: str = "10 minutes") -> StreamingQuery:
    """Tells what has settled into ``sink``; a batch that is run again overwrites its own files only."""
    spark = reactions.sparkSession
    delay = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {late}"))).first()[0]
    forward, skew = FORWARD_S * 1_000_000, SKEW_S * 1_000_000
    r, c = _rows(reactions, captures)
    both = r.withColumn("asks", F.lit(True)).unionByName(c.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    mine = ("message_id", "user_id", "run_id", "at", "hash"), ("capture_id", "user_id", "run_id", "at", "hashes")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store, seen = Store(session, f"{checkpoint}/open"), lambda i: f"{checkpoint}/open/seen-{i}"
        before = store.read(f"state-{batch_id - 1}.json") if batch_id else {"r": None, "c": None, "mark": None}
        rows, mark = batch, before["mark"]
        if mark is not None:
            rows = rows.where(F.col("at") > mark)
        if batch_id:
            rows = rows.unionByName(session.read.schema(batch.schema).parquet(seen(batch_id - 1)).where(F.lit(True) if mark is None else F.col("at") > mark - forward - F.when(F.col("asks"), 0).otherwise(skew)))
        rows.write.mode("overwrite").parquet(seen(batch_id))
        rows = session.read.schema(batch.schema).parquet(seen(batch_id))
        last = rows.agg(F.max(F.when(F.col("asks"), F.col("at"))).alias("r"), F.max(F.when(~F.col("asks"), F.col("at"))).alias("c")).first()
        now = {k: max((x for x in (before[k], last[k]) if x is not None), default=None) for k in ("r", "c")}
        now["mark"] = mark if None in now.values() else max(min(now.values()) - delay, mark if mark is not None else min(now.values()) - delay)
        settled = F.lit(False) if now["mark"] is None else F.col("at") + forward <= now["mark"]
        told = _told(rows.where(F.col("asks") & settled).select(*mine[0]), rows.where(~F.col("asks")).select(*mine[1]))
        told.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)
        store.write(f"state-{batch_id}.json", now)
        for name in (f"seen-{batch_id - 2}", f"state-{batch_id - 2}.json"):
            store.fs.delete(store.path(name), True)

    return both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
