"""Evaluation measures: gates, sweeps, resampling, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.session import written

SATURATED, GUARDED, PRESSURE = 0.05, 0.25, 0.75  # fixed values of the checks


def verdict_gate(rows: DataFrame) -> DataFrame:
    """Totals, matches and their share by expected ``pool``."""
    s = rows.groupBy("pool").agg(F.count("*").alias("total"), F.count_if(F.col("observed") == F.col("pool")).alias("matched"))
    return s.withColumn("match_rate", F.round(F.col("matched") / F.col("total"), 3))


def inert(target: Column, nearest: Column) -> Column:
    """Whether the best distractors stay so far below the targets that they say nothing; unmeasured counts as inert."""
    return F.coalesce(F.when(target > 0, nearest / target < PRESSURE), F.lit(True))


def undated_arm(per: DataFrame) -> DataFrame:
    """One row from (first, hit, weakest) by query: share found in five, mean rank of what was found, and how much
    further demotion the hits could take."""
    room = F.when(F.col("weakest") > 0, F.col("hit") / F.col("weakest"))
    return per.agg(
        F.round(F.avg(F.coalesce((F.col("first") <= 5).cast("double"), F.lit(0.0))), 6).alias("g2"), F.round(F.avg("first"), 6).alias("mean_rank"), F.count("first").alias("rows_ranked"),
        F.count_if(F.col("first").isNull()).alias("rows_unranked"), F.round(F.percentile(room, 0.5), 6).alias("headroom"), F.round(F.min(room), 6).alias("least_headroom"),
    )


def _unit(*seed: Column) -> Column:
    """A number in [0, 1) that the values of a row decide."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 53)) / float(1 << 53)


def bootstrap_f_half(rows: DataFrame, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """Mean and interval of F0.5 of (k, said, true) rows over resamples.

    A row's weight in a resample is a Poisson draw of its key's hash, so the resamples need no order, no driver and
    no copy of the rows beyond ``replicates`` narrow ones that are summed at once.
    """
    each = rows.select("k", "said", "true", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b"))
    u, bounds, total, term = _unit(F.col("k"), F.col("b")), [], 0.0, 2.718281828459045**-1
    for i in range(8):
        total += term
        bounds.append(total)
        term /= i + 1
    weight = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    w = each.withColumn("w", weight)
    of = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    s = w.groupBy("b").agg(of(F.col("said") & F.col("true")).alias("tp"), of(F.col("said") & ~F.col("true")).alias("fp"), of(~F.col("said") & F.col("true")).alias("fn"))
    f = F.coalesce(F.try_divide(1.25 * F.col("tp"), 1.25 * F.col("tp") + 0.25 * F.col("fn") + F.col("fp")), F.lit(0.0))
    tail = (1 - level) / 2
    return s.select(f.alias("f")).agg(F.percentile("f", [tail, 1 - tail]).alias("p"), F.avg("f").alias("mean")).select(F.round("mean", 6).alias("mean"), F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"))


def dedup_report(rows: DataFrame) -> DataFrame:
    """Share merged by ``kind``; merges of controls are false."""
    false = F.count_if((F.col("kind") == "control") & F.col("merged"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("merged").cast("double")), 6).alias("merge_rate"), false.alias("false_merges"))


def lane_grid(rows: DataFrame, taus: list[float], margins: list[float]) -> DataFrame:
    """``tp``, ``said`` and ``expected`` for each threshold and margin, from one pass over the rows."""
    cells = [(t, m) for t in taus for m in margins]
    said = lambda t, m: F.col("predicted").isNotNull() & (F.col("score") >= t) & (F.col("score") - t >= m)
    right = F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    sums = [x for i, (t, m) in enumerate(cells) for x in (F.count_if(said(t, m)).alias(f"s{i}"), F.count_if(said(t, m) & right).alias(f"t{i}"))]
    table = F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(m).alias("margin"), F.col(f"t{i}").alias("tp"), F.col(f"s{i}").alias("said")) for i, (t, m) in enumerate(cells)))
    return rows.agg(*sums, F.count("expected").alias("expected")).select(F.explode(table).alias("x"), "expected").select("x.*", "expected")


def grade_sweep(rows: DataFrame, taus: list[float]) -> DataFrame:
    """Outcomes of (answers, confidence, gold) at each threshold.

    Rows are counted by the number of thresholds they reach; the sweep sums those counts.
    """
    reached = sum(((F.col("confidence") >= t).cast("int") for t in taus), F.lit(0))
    step = F.when(F.col("answers"), reached).otherwise(0)
    cells = rows.groupBy(step.alias("step"), "gold").agg(F.count("*").alias("n"))  # at most two for each threshold
    table = F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(i + 1).alias("least")) for i, t in enumerate(taus)))
    each = cells.select("step", "gold", "n", F.explode(table).alias("x"))
    said = F.col("step") >= F.col("x.least")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy(F.col("x.tau").alias("tau")).agg(of(said & F.col("gold")).alias("tp"), of(said & ~F.col("gold")).alias("fp"), of(~said & F.col("gold")).alias("fn"), of(~said & ~F.col("gold")).alias("tn"))


# Standard deviations around a cut's likely place at which hashes are counted.
EDGES = (-6.0, -2.0, -1.2, -0.6, 0.0, 0.6, 1.2, 2.0, 6.0)


def permutation_test(rows: DataFrame, rounds: int = 200) -> DataFrame:
    """``observed`` difference of the means of cases and others in ``value``, and the share ``p`` of ``rounds`` random
    dealings within weeks that reach it.

    A round deals labels by rank of a hash within its week, so weeks keep their numbers of cases.  Only the few rows
    whose hash lies near a cut are ranked: hashes are counted at some edges around the place where a cut is likely,
    and rows beyond the two edges around it are summed where they are read.  Wherever the cut is, the ranks are exact.
    """
    observed = rows.agg((F.avg(F.when(F.col("case"), F.col("value"))) - F.avg(F.when(~F.col("case"), F.col("value")))).alias("observed"))
    sizes = rows.where("week IS NOT NULL").groupBy("week").agg(F.count("*").alias("n"), F.count_if("case").alias("cases"))
    share = F.col("cases") / F.col("n")
    place = lambda e: F.least(F.greatest(share + e * F.sqrt(share * (1 - share) / F.col("n")), F.lit(1e-15)), F.lit(1 - 1e-15))
    sizes = written(sizes.select("week", "cases", *(((place(e) - 0.5) * 2.0**64).cast("bigint").alias(f"e{i}") for i, e in enumerate(EDGES))))  # a row a week
    rank, edges = F.xxhash64("k", "round"), range(len(EDGES))
    each = rows.join(F.broadcast(sizes), "week").select("week", "k", *(f"e{i}" for i in edges), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    below = each.withColumn("h", rank).groupBy("week", "round").agg(*(F.count_if(F.col("h") < F.col(f"e{i}")).alias(f"n{i}") for i in edges))
    upto = lambda c: F.greatest(*(F.when(F.col(f"n{i}") <= F.col("cases"), F.col(f"{c}{i}")) for i in edges))
    high = F.least(*(F.when(F.col(f"n{i}") >= F.col("cases"), F.col(f"e{i}")) for i in edges))
    cuts = written(below.join(sizes, "week").select("week", "round", upto("e").alias("low"), high.alias("high"), (F.col("cases") - F.coalesce(upto("n"), F.lit(0))).alias("more")))
    by_week = cuts.groupBy("week").agg(F.collect_list(F.struct("round", "low", "high")).alias("cuts"))
    dealt = rows.select("k", "week", F.col("value").cast("double").alias("value")).join(F.broadcast(by_week), "week").select("k", "week", "value", F.inline("cuts")).withColumn("h", rank)
    side = F.when(F.col("h") < F.col("low"), "case").when(F.col("h") >= F.col("high"), "other").otherwise("near")
    near = lambda c: F.when(F.col("side") == "near", F.col(c)).alias(f"_{c}")
    told = dealt.withColumn("side", side).groupBy("round", "side", *map(near, ("week", "h", "k", "value")))
    told = told.agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("total"))
    so_far = F.sum("n").over(Window.partitionBy("round", "_week").orderBy("_h", "_k", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = told.withColumn("so_far", so_far).join(cuts.select("round", F.col("week").alias("_week"), "more"), ["round", "_week"], "left")
    taken = F.when(F.col("side") == "case", F.col("n")).when(F.col("side") == "other", 0).otherwise(F.greatest(F.least("n", F.col("more") - F.col("so_far") + F.col("n")), F.lit(0)))
    met = met.withColumn("taken", taken).withColumn("left", F.col("n") - F.col("taken"))
    # The rows of one line near a cut have the same value.
    mean = lambda c: F.try_divide(F.sum(F.when(F.col(c) > 0, F.when(F.col(c) == F.col("n"), F.col("total")).otherwise(F.col("_value") * F.col(c)))), F.sum(F.when(F.col("valued") > 0, F.when(F.col(c) == F.col("n"), F.col("valued")).otherwise(F.col(c)))))
    diff = met.groupBy("round").agg((mean("taken") - mean("left")).alias("d"))
    return diff.crossJoin(F.broadcast(observed)).agg(F.round(F.first("observed"), 6).alias("observed"), F.round((F.count_if(F.col("d") >= F.col("observed")) + 1) / (F.count("*") + 1), 6).alias("p"))


def trigger(scoped: Column, cases: Column, pool: Column, unscoped: Column, late: Column, floor: int, late_floor: int) -> Column:
    arm = F.when(late, late_floor).otherwise(floor)
    return (
        F.when((unscoped >= arm) & (scoped < arm), "SCOPING-ARTIFACT").when((cases >= floor) & (pool >= cases), "RUN").when(late & (cases >= late_floor) & (pool >= cases), "RUN")
        .when(late & (cases < late_floor) & (unscoped < late_floor), "PARK-SPARSE").otherwise("WAIT")
    )


def attribution(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``mode`` and ``class`` of each reference (capture_id, point_id, event, near)."""
    f = first.select("point_id", F.col("capture_id").alias("first"))
    own = F.when(F.col("event") == "ADD", "authored").otherwise("inherited")
    guessed = F.when((F.col("first") == F.col("capture_id")) & F.col("near"), "authored").otherwise("inherited")
    met = rows.join(f, "point_id")
    return met.select("capture_id", "point_id", F.when(F.col("event").isNotNull(), "event").otherwise("heuristic").alias("mode"), F.when(F.col("event").isNotNull(), own).otherwise(guessed).alias("class"))


def distractors(numbers: DataFrame, lanes: DataFrame, templates: int, seed: int = 0) -> DataFrame:
    """A filler text for each ``i`` of ``numbers``, which its number and the lanes (``lane``) in use alone decide: lanes in turn, then
    templates, then the next combination.  Null lanes are none; without lanes there is no filler."""
    every = Window.partitionBy()
    known = lanes.where("lane IS NOT NULL").select("lane").distinct()  # a row a lane
    placed = known.select("lane", (F.row_number().over(Window.orderBy("lane")) - 1).alias("_k"), F.count("*").over(every).alias("_n"))
    n = placed.agg(F.max("_n").alias("_all"))
    turn = numbers.select("i").join(F.broadcast(n), F.lit(True)).withColumn("_turn", F.expr("i % _all"))  # one row
    within = F.floor(F.col("i") / F.col("_n")) + seed
    text = F.concat(F.lit("template "), (within % templates).cast("string"), F.lit(" of "), F.floor(within / templates).cast("string"))
    return turn.join(placed, F.col("_turn") == F.col("_k")).select("i", "lane", text.alias("text"))


def hard_negatives(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """For each query (k, lane, term) the other row of its lane with most terms in common (the least of several).

    Rows with the same terms count alike, so sets of terms meet, not rows; a set needs no more than its two least
    rows, as a query leaves out one row only, itself.
    """
    two = lambda rows, by, *order: rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_r <= 2")

    def sets(rows: DataFrame) -> DataFrame:
        listed = rows.where("lane IS NOT NULL AND term IS NOT NULL").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("lane", "term"))).alias("terms"))
        return listed.select("k", F.to_json("terms").alias("set"), "terms")

    def words(held: DataFrame, key: str) -> DataFrame:
        return held.select(key, F.inline("terms")).groupBy(key, "lane", "term").agg(F.count("*").alias(f"n_{key}"))

    asked = written(sets(queries))
    all_ = two(sets(terms), "set", "k").groupBy("set").agg(F.array_sort(F.collect_list("k")).alias("rows"), F.first("terms").alias("terms"))
    all_ = written(all_.select(F.col("rows")[0].alias("first"), "rows", "terms"))
    ways = written(asked.groupBy("set").agg(F.min("k").alias("way"), F.first("terms").alias("terms")))
    met = words(ways, "way").join(words(all_, "first"), ["lane", "term"])
    shared = met.groupBy("way", "first").agg(F.sum(F.col("n_way") * F.col("n_first")).alias("shared"))
    best = two(shared.join(all_.select("first", F.explode("rows").alias("negative")), "first"), "way", F.col("shared").desc(), "negative")
    found = asked.join(ways.select("set", "way"), "set").join(best, "way").where("k <> negative")
    least = found.groupBy("k").agg(F.min(F.struct((-F.col("shared")).alias("s"), "negative")).alias("x"))
    return least.select(F.col("k").alias("query"), F.col("x.negative").alias("negative"), (-F.col("x.s")).alias("shared"))
