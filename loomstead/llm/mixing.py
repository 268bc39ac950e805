"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are token counts.  Sources, in order of code points with null last,
weigh 1, 2, 3 and so on in turn, and share the size of all; a target stops at
``CAP`` times its source's size and the excess is shared again by weight.  A
source is taken whole as often as it fits; the remaining budget is fitted on
the histogram of exact lengths: an even share of every length first, then the
rest by a bounded-knapsack dynamic programme over the copies left.  Which
documents of a length are taken follows a seeded hash of their ids.

What meets in one task: the sources' sums (one row a source), and one
source's histogram (one row a distinct length, whatever the rows).

Defined results: null and empty texts have size 0 and are taken 0 times;
repeated rows are documents of their own (equal ids fall next to each other
in the seeded order); the null source is a source; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import written

CAP = 3
EXACT = 50_000
WORK = 1 << 31  # bits that a source's knapsack may hold: 256 MB
BUCKETS = 64

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: int = 3, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from (source, size) sums.

    Raising all sources together, those with the least cap per weight stop
    first; the level at which the rest share what is left is read off running
    sums over the sources in that order.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    s = sizes.withColumn("weight", (F.row_number().over(order) - 1) % weights + 1)
    s = s.withColumn("most", cap * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("open"))
    reached = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    s = s.withColumn("stop", F.first(reached, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least("most", F.coalesce(F.col("stop") * F.col("weight"), F.col("most"))).alias("target"))


def fill(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many documents of each size to take, so that the sum comes as near ``budget`` as it can.

    An even share of every size, then large ones while much is missing, then a
    bounded knapsack over what is left: reachable sums are the bits of an
    integer, each size adds its copies in powers of two, and the steps are
    walked back from the best sum.
    """
    take = {s: 0 for s in sizes}
    left = dict(zip(sizes, counts, strict=True))
    total = sum(s * n for s, n in left.items())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return left
    # The even share stops short of the budget by a few documents, which the knapsack then chooses.
    part = max(0, budget - min(EXACT // 2, 8 * max(sizes))) / total
    rest = budget
    for s in sizes:
        take[s] = min(int(left[s] * part), rest // s)
        rest -= take[s] * s
    for s in sorted(sizes, reverse=True):
        if rest <= EXACT:
            break
        more = min(left[s] - take[s], (rest - EXACT // 2) // s)
        if more > 0:
            take[s] += more
            rest -= more * s
    near = _reach(take, left, rest)
    miss = lambda got: abs(budget - sum(n * k for n, k in got.items()))
    if miss(near) and (budget + max(sizes)) * sum(n.bit_length() for n in counts) <= WORK:
        exact = _reach(dict.fromkeys(sizes, 0), left, budget)  # the even share may have barred the nearest sum
        near = exact if miss(exact) < miss(near) else near
    return near


def _reach(taken: dict[int, int], left: dict[int, int], rest: int) -> dict[int, int]:
    """``taken`` and what the bounded knapsack adds from the remaining documents to come nearest to ``rest`` more."""
    take, sizes = dict(taken), list(taken)
    # The sums within reach of the rest, and those that end just past it.
    top = min(rest + max(sizes), max(4 * EXACT, WORK // sum(left[s].bit_length() for s in sizes)))
    mask = (1 << (top + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    bits = 1
    for s in sorted(sizes, reverse=True):
        n, k = min(left[s] - take[s], top // s), 1
        while n > 0 and not bits >> rest & 1:
            k = min(k, n)
            steps.append((s, k, bits))
            bits |= bits << (s * k) & mask
            n -= k
            k *= 2
        if bits >> rest & 1:
            break
    below = (bits & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = bits >> (rest + 1)
    up = rest + 1 + ((above & -above).bit_length() - 1) if above else None
    best = up if up is not None and up - rest < rest - below else below
    for s, k, was in reversed(steps):
        if not was >> best & 1:
            best -= s * k
            take[s] += k
    return take


def _fit(histogram: pd.DataFrame) -> pd.DataFrame:
    h = histogram.sort_values("size", kind="stable")
    whole, budget = int(h["whole"].iloc[0]), int(h["budget"].iloc[0])
    chosen = fill(h["size"].tolist(), h["n"].tolist(), budget)
    return pd.DataFrame({"source": h["source"], "size": h["size"], "whole": whole, "chosen": [chosen[s] for s in h["size"]]})


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, size: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` for each row of ``docs``.

    ``taken`` is a multiple of ``size``.  The rank of a document in its
    (source, size) class is found in two steps, by buckets of the seeded hash,
    so that a class that holds a third of all rows is spread over its buckets.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (word_count(F.col(text_col)) if size is None else size).alias("size")
    )
    sized = written(sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    targets = written(targets)
    same = F.col("t.source").eqNullSafe(F.col("source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.select(F.col("source").alias("s"), whole.alias("whole"), F.round(F.col("target") - whole * F.col("source_size")).cast("bigint").alias("budget"))
    filled = (
        histogram.where("size > 0").join(budgets, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "whole", "budget")
        .groupBy("source").applyInPandas(_fit, "source string, size bigint, whole bigint, chosen bigint")
    )
    filled = written(filled)
    cell = ["source", "size", "bucket"]
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy(*cell).agg(F.count("*").alias("k")).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0)))
    plan = starts.alias("c").join(filled.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.size") == F.col("f.size")), "left").select(
        F.col("c.source").alias("source"), F.col("c.size").alias("size"), F.col("c.bucket").alias("bucket"), "start",
        F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("chosen", F.lit(0)).alias("chosen"),
    )
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "doc_id")))
    joined = ranked.alias("r").join(
        plan.alias("p"),
        F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.bucket") == F.col("p.bucket")),
    )
    times = F.col("whole") + ((F.col("start") + F.col("rank")) <= F.col("chosen")).cast("bigint")
    taken = joined.select("doc_id", F.col("r.source").alias("source"), F.col("r.size").alias("size"), (times * F.col("r.size")).alias("taken"))
    return taken.alias("d").join(targets.alias("t"), F.col("t.source").eqNullSafe(F.col("d.source"))).select(
        "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "taken"
    )
