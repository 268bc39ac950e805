"""Counters, freshness, growth, latency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.scan import quantiles

OUTCOMES = ("stored", "abstained", "deduped", "superseded", "error", "failed")  # fixed values


def counters(signals: DataFrame) -> DataFrame:
    """Counter table: one row for each day, surface, project, event and outcome."""
    return signals.groupBy("day", "surface", "project", "event", "outcome").agg(F.count("*").alias("n"))


def _window(day: Column, today: str, days: int = 7) -> Column:
    end = F.to_date(F.lit(today))
    return day.between(F.date_sub(end, days - 1), end)


def last_seen(counts: DataFrame) -> DataFrame:
    return counts.where("event LIKE 'capture.%'").groupBy("surface").agg(F.max("day").alias("last_day"))


def freshness_hours(day: Column, now: str) -> Column:
    """Hours from the end of a day to now, at least 0, to one decimal."""
    hours = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.date_add(day, 1).cast("timestamp"))) / 3600.0
    return F.round(F.greatest(hours, F.lit(0.0)), 1)


def window_counts(counts: DataFrame, today: str) -> DataFrame:
    now = F.col("day") == F.to_date(F.lit(today))
    return counts.where(_window(F.col("day"), today)).groupBy("surface").agg(
        F.sum("n").alias("events_7d"), F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("events_today"),
        F.coalesce(F.sum(F.when(now & F.col("outcome").isin("error", "failed"), F.col("n"))), F.lit(0)).alias("errors_today"),
    )


def outcomes(counts: DataFrame, today: str, events: tuple[str, ...] = ("capture.extraction", "capture.checkpoint")) -> DataFrame:
    """Six buckets a surface, zero where nothing was counted; other outcomes are left out."""
    sums = [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o) for o in OUTCOMES]
    return counts.where(_window(F.col("day"), today) & F.col("event").isin(*events)).groupBy("surface").agg(*sums)


def event_sums(counts: DataFrame, today: str, event: str) -> DataFrame:
    now = F.col("day") == F.to_date(F.lit(today))
    return counts.where(_window(F.col("day"), today) & (F.col("event") == event)).groupBy("surface").agg(
        F.sum("n").alias("n_7d"), F.coalesce(F.sum(F.when(now, F.col("n"))), F.lit(0)).alias("n_today")
    )


def growth(counts: DataFrame, today: str, event: str, kept: tuple[str, ...], days: int = 7) -> DataFrame:
    """Seven days in full, with 0 where nothing was kept."""
    end = F.to_date(F.lit(today))
    calendar = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    sums = counts.where((F.col("event") == event) & F.col("outcome").isin(*kept)).groupBy("day").agg(F.sum("n").alias("n"))
    return calendar.join(sums, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def corpus_by_project(points: DataFrame) -> DataFrame:
    return points.groupBy(F.coalesce(F.nullif(F.trim("project"), F.lit("")), F.lit("(unknown)")).alias("project")).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """Count, least, greatest, mean and nearest-rank quantiles of the finite values."""
    finite = rows.withColumn("_v", value).where("_v IS NOT NULL AND NOT isnan(_v)")
    summed = finite.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.round(F.avg("_v"), 6).alias("mean"))
    ranks = quantiles(finite, list(by), "_v", {"p50": 0.5, "p95": 0.95})
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}"))
    return summed.alias("s").join(ranks.alias("q"), same).select("s.*", "q.p50", "q.p95")


def histogram(rows: DataFrame, value: Column, bounds: tuple[float, ...], *by: str) -> DataFrame:
    """Cumulative counts at or below each bound."""
    sums = [F.sum((value <= b).cast("bigint")).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*by).agg(*sums, F.count("*").alias("n"))


def fold_tally(old: DataFrame, pruned: DataFrame) -> DataFrame:
    """Counts of pruned rows added to a tally."""
    fresh = pruned.groupBy("day", "user_id", "surface", "verdict").agg(F.count("*").alias("n"))
    return old.unionByName(fresh).groupBy("day", "user_id", "surface", "verdict").agg(F.sum("n").alias("n"))


def over_budget(spend: DataFrame, cap: float) -> DataFrame:
    return spend.groupBy("day", "project").agg(F.round(F.sum("cost"), 4).alias("spent")).withColumn("stop", F.col("spent") >= cap)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return F.coalesce(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, F.lit(0.0))


def freshness_verdict(last: DataFrame, now: str, threshold_hours: float, surface: str | None = None) -> DataFrame:
    """One row: the named or the freshest surface, FRESH within the threshold, else STALE."""
    hours = last.select("surface", freshness_hours(F.col("last_day"), now).alias("hours"))
    if surface:
        hours = hours.where(F.col("surface") == surface)
    best = hours.agg(F.min(F.struct("hours", "surface")).alias("b")).select("b.surface", "b.hours")
    return best.withColumn("verdict", F.when(F.col("hours") <= threshold_hours, "FRESH").otherwise("STALE"))


def confusion(judged: DataFrame) -> DataFrame:
    """Expected by predicted with a null bucket, zero where a cell is empty."""
    name = lambda c: F.coalesce(c, F.lit("(none)"))
    cells = judged.groupBy(name(F.col("expected")).alias("expected"), name(F.col("predicted")).alias("predicted")).agg(F.count("*").alias("n"))
    rows, cols = cells.select("expected").distinct(), cells.select("predicted").distinct()
    # Both axes hold class names only, a handful of rows.
    return rows.crossJoin(F.broadcast(cols)).join(cells, ["expected", "predicted"], "left").fillna(0, ["n"])
