"""Conversation turns as a stream: bounded micro-batches, late turns, packed chunks, idempotent summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.functions.text import summary_id

BUDGET, THIN_BYTES, THIN_TURNS, LATE = 200_000, 500, 2, "48 hours"  # fixed values
TURN = "project string, turn_iso string, role string, content string"


def read_turns(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines turns as a bounded stream with a watermark of two days, each turn once."""
    rows = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_batch).json(path)
    rows = rows.withColumn("ts", F.try_to_timestamp("turn_iso")).where("ts IS NOT NULL AND role IN ('user', 'assistant', 'system')")
    return rows.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["project", "turn_iso", "role", "content"])


def pack(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``chunk`` number of every turn: whole turns up to ``budget`` bytes, in order, within a project's day.

    The sum starts anew where it would pass the budget, which no window
    expresses; a group is one project's day.
    """

    def number(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["turn_iso", "role", "content"], kind="stable")
        chunk, held, out = 0, 0, []
        for n in day["size"]:
            if held and held + n > budget:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return day.assign(chunk=out).drop(columns="size")

    sized = turns.select("project", F.substring("turn_iso", 1, 10).alias("day"), "turn_iso", "role", "content", F.octet_length("content").alias("size"))
    return sized.groupBy("project", "day").applyInPandas(number, "project string, day string, turn_iso string, role string, content string, chunk int")


def summaries(packed: DataFrame) -> DataFrame:
    """One row a chunk that is not thin (few bytes and few turns), under an id its turns decide."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_iso", "role", "content"))), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    s = packed.groupBy("project", "day", "chunk").agg(
        F.min("turn_iso").alias("start"), F.max("turn_iso").alias("end"), F.count("*").alias("turns"), F.sum(F.octet_length("content")).alias("bytes"), text.alias("transcript")
    )
    thick = ~((F.col("bytes") < THIN_BYTES) & (F.col("turns") < THIN_TURNS))
    return s.where(thick).withColumn("summary_id", summary_id(F.col("project"), F.col("day"), F.col("start"), F.col("end")))


def run_checkpoints(turns: DataFrame, sink: str, checkpoint: str, budget: int = BUDGET) -> StreamingQuery:
    """Drains the backlog into ``sink``; a batch that is run again overwrites its own files only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = summaries(pack(batch, budget)).withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summaries(spark: SparkSession, sink: str) -> DataFrame:
    """The latest row of each summary id."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("summary_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "summary_id")), "batch").alias("r")).select("summary_id", "r.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window, surface and kind; late ones within the watermark are counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
