"""Running values and exact quantiles over long keys, in sorted ranges rather than a task a key.

Rows are dealt into ranges of (keys, order), so a key that holds a third of all
rows lies in many ranges.  Each range runs by itself; only keys that go on from
one range into the next carry something over, and there are at most two of
them a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import written


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, how: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the ``max``, ``sum`` or ``last`` non-null ``value`` of a key from its first row to this one.

    ``order`` should make rows of a key unlike; rows that tie in it may fall in
    either order, as in a window over them.  Null keys are keys; where no value
    has come yet, the result is null.
    """
    ranged = written(rows.withColumn("_running_v", value).repartitionByRange(*keys, *order).withColumn("_running_part", F.spark_partition_id()))
    so_far = Window.partitionBy("_running_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_running_part").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    folds = {
        "max": (F.max("_running_v"), F.max, lambda old, new: F.greatest(old, new)),
        "sum": (F.sum("_running_v"), F.sum, lambda old, new: F.coalesce(old + new, old, new)),
        "last": (F.max_by("_running_v", F.when(F.col("_running_v").isNotNull(), place)), lambda c: F.last(c, ignorenulls=True), lambda old, new: F.coalesce(new, old)),
    }
    whole, over, join = folds[how]
    parts = ranged.groupBy("_running_part", *keys).agg(whole.alias("_running_all"))
    carried = parts.withColumn("_running_old", over(F.col("_running_all")).over(before)).where("_running_old IS NOT NULL").select(*keys, "_running_part", "_running_old")
    same = F.col("r._running_part") == F.col("c._running_part")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    local = ranged.withColumn("_running_new", over(F.col("_running_v")).over(so_far))
    # A row for each range that a key goes on into: fewer than the ranges.
    met = local.alias("r").join(F.broadcast(carried).alias("c"), same, "left")
    return met.select(*(F.col(f"r.`{c}`") for c in rows.columns), join(F.col("c._running_old"), F.col("r._running_new")).alias(out))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], *, interpolated: bool = False) -> DataFrame:
    """Exact quantiles of the non-null, non-NaN values of each group of ``by``, a column for each of ``shares``.

    Equal values are counted first; running sums of the counts tell which value
    stands at a rank, so no task holds a group's values.  A share takes the
    least value at or below which that share of the values lies or, if
    ``interpolated``, the line between the two values around it.
    """
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = running(counts, by, [value], F.col("_n"), "sum", "_upto")
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))  # a row a group
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"u.{k}").eqNullSafe(F.col(f"t.{k}"))
    placed = upto.alias("u").join(totals.alias("t"), same).select(*(F.col(f"u.{k}") for k in by), F.col(f"u.{value}").alias("_v"), "_n", "_upto", "_total")
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto")), F.col("_v")))
    picks = []
    for name, share in shares.items():
        if interpolated:
            place = F.lit(share) * (F.col("_total") - 1)
            picks += [at(F.floor(place) + 1).alias(f"_{name}0"), at(F.ceil(place) + 1).alias(f"_{name}1"), F.max(place - F.floor(place)).alias(f"_{name}w")]
        else:
            picks.append(at(F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_total")))).alias(name))
    found = placed.groupBy(*by).agg(*picks)
    if interpolated:
        between = lambda n: F.col(f"_{n}0") * (1 - F.col(f"_{n}w")) + F.col(f"_{n}1") * F.col(f"_{n}w")
        found = found.select(*by, *(F.when(F.col(f"_{n}0") == F.col(f"_{n}1"), F.col(f"_{n}0")).otherwise(between(n)).alias(n) for n in shares))
    return found
