"""Evaluation measures over the derived tables, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import attribution as A
from loomstead.operators import graph as G
from loomstead.operators import measures as M
from loomstead.operators import recall as R
from loomstead.operators import retrieval as V
from loomstead.operators.scan import quantiles
from loomstead.plans.memory import query

_RANKED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank FROM judged"


@query(
    "e05_contains_answer", "turns",
    "SELECT conv_id, max(CASE WHEN turn <= 5 AND contains(lower(text), 'the') THEN 1 ELSE 0 END) AS at_5, round(coalesce(1.0 / min(CASE WHEN contains(lower(text), 'the') THEN turn + 1 END), 0), 6) AS rr FROM turns GROUP BY conv_id",
)
def _(turns):
    """A session answers where one of its first turns contains the answer."""
    hit = F.contains(F.lower("text"), F.lit("the"))
    at_5 = F.max(F.when((F.col("turn") <= 5) & hit, 1).otherwise(0))
    return turns.groupBy("conv_id").agg(at_5.alias("at_5"), F.round(F.coalesce(1 / F.min(F.when(hit, F.col("turn") + 1)), F.lit(0.0)), 6).alias("rr"))


@query(
    "e07_verdict_gate", "judged",
    "SELECT pool, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (observed = pool) AS BIGINT) AS matched, round(count(*) FILTER (observed = pool) / count(*)::DOUBLE, 3) AS match_rate FROM (SELECT CASE WHEN relevant THEN 'extract' ELSE 'abstain' END AS pool, CASE WHEN score > 0.5 THEN 'extract' ELSE 'abstain' END AS observed FROM judged WHERE k % 11 <> 0) GROUP BY pool",
)
def _(judged):
    """Share of matching verdicts by expected pool, without unstable rows."""
    verdict = lambda c: F.when(c, "extract").otherwise("abstain")
    rows = judged.where("k % 11 <> 0").select(verdict(F.col("relevant")).alias("pool"), verdict(F.col("score") > 0.5).alias("observed"))
    return M.verdict_gate(rows)


@query(
    "e09_saturation", "judged",
    "SELECT level, (1000000 - count(*)) / 1000000.0 > 0.05 AS dedup_saturated, count(*) FILTER (relevant) / count(*)::DOUBLE > 0.25 AS guard_saturated, coalesce(avg(score) FILTER (NOT relevant) / nullif(avg(score) FILTER (relevant), 0) < 0.75, TRUE) AS inert FROM judged GROUP BY level",
)
def _(judged):
    """Whether a corpus shrank too far, a guard flagged too much, or distractors came nowhere near their targets."""
    n, hits = F.count("*"), F.count_if("relevant")
    near, target = F.avg(F.when(~F.col("relevant"), F.col("score"))), F.avg(F.when(F.col("relevant"), F.col("score")))
    return judged.groupBy("level").agg(
        ((F.lit(1_000_000) - n) / 1_000_000 > M.SATURATED).alias("dedup_saturated"), (hits / n > M.GUARDED).alias("guard_saturated"), M.inert(target, near).alias("inert")
    )


@query(
    "e11_undated_arm", "judged",
    f"SELECT * FROM (WITH g AS (SELECT qid, rank, score, min(score) OVER (PARTITION BY qid) AS weakest, relevant FROM (SELECT * FROM ({_RANKED}) WHERE rank <= 10)), h AS (SELECT qid, min(rank) FILTER (relevant) AS first, max(score) FILTER (relevant) AS hit, max(weakest) AS weakest FROM g GROUP BY qid) "
    "SELECT round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS g2, round(avg(first), 6) AS mean_rank, CAST(count(first) AS BIGINT) AS rows_ranked, CAST(count(*) - count(first) AS BIGINT) AS rows_unranked, round(median(hit / weakest) FILTER (weakest > 0), 6) AS headroom, round(min(hit / weakest) FILTER (weakest > 0), 6) AS least_headroom FROM h)",
)
def _(judged):
    top = V.ranked(judged).where("rank <= 10")
    per = top.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.max(F.when(F.col("relevant"), F.col("score"))).alias("hit"), F.min("score").alias("weakest"))
    return M.undated_arm(per)


@query("e14_bootstrap_ci", "judged")
def _(judged):
    """Interval of F0.5 over 200 resamples; Poisson weights of a row's hash stand for drawing with replacement."""
    rows = judged.select("k", (F.col("score") >= 0.5).alias("said"), F.col("relevant").alias("true"))
    return M.bootstrap_f_half(rows, replicates=200)


@query(
    "e16_dedup_report", "judged",
    "SELECT CASE k % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'paraphrase' ELSE 'control' END AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN score > 0.4 THEN 1.0 ELSE 0.0 END), 6) AS merge_rate, CAST(count(*) FILTER (k % 3 = 2 AND score > 0.4) AS BIGINT) AS false_merges FROM judged GROUP BY 1",
)
def _(judged):
    kind = F.when(F.col("k") % 3 == 0, "exact").when(F.col("k") % 3 == 1, "paraphrase").otherwise("control")
    return M.dedup_report(judged.select(kind.alias("kind"), (F.col("score") > 0.4).alias("merged")))


@query(
    "e17_lane_grid", "judged",
    "SELECT tau, margin, CAST(count(*) FILTER (said AND predicted = expected) AS BIGINT) AS tp, CAST(count(*) FILTER (said) AS BIGINT) AS said, CAST(count(expected) AS BIGINT) AS expected FROM (SELECT predicted, expected, t / 10.0::DOUBLE AS tau, m / 20.0::DOUBLE AS margin, predicted IS NOT NULL AND score >= t / 10.0::DOUBLE AND score - t / 10.0::DOUBLE >= m / 20.0::DOUBLE AS said FROM judged, range(0, 10) a(t), range(0, 4) b(m)) GROUP BY tau, margin",
)
def _(judged):
    """Counts behind precision and recall for each threshold and margin; the grid is a list of sums in one pass."""
    return M.lane_grid(judged, [t / 10 for t in range(10)], [m / 20 for m in range(4)])


@query(
    "t10_threshold_picker", "judged",
    "SELECT tau, margin FROM (SELECT tau, margin, tp / nullif(said, 0)::DOUBLE AS p, tp / expected::DOUBLE AS r FROM (SELECT tau, margin, count(*) FILTER (said AND predicted = expected) AS tp, count(*) FILTER (said) AS said, count(expected) AS expected FROM (SELECT predicted, expected, t / 10.0::DOUBLE AS tau, m / 20.0::DOUBLE AS margin, predicted IS NOT NULL AND score >= t / 10.0::DOUBLE AND score - t / 10.0::DOUBLE >= m / 20.0::DOUBLE AS said "
    "FROM judged, range(0, 10) a(t), range(0, 4) b(m)) GROUP BY tau, margin)) WHERE p >= 0.1 ORDER BY r DESC, p DESC, margin, tau LIMIT 1",
)
def _(judged):
    """Of the cells precise enough: most recall, then most precision, least margin, least threshold."""
    grid = M.lane_grid(judged, [t / 10 for t in range(10)], [m / 20 for m in range(4)])
    cells = grid.select("tau", "margin", F.try_divide(F.col("tp"), F.col("said")).alias("p"), F.try_divide(F.col("tp"), F.col("expected")).alias("r"))
    return cells.where("p >= 0.1").orderBy(F.col("r").desc(), F.col("p").desc(), "margin", "tau").limit(1).select("tau", "margin")


def _grades(rows: str) -> str:
    return (
        f"SELECT tau, CAST(count(*) FILTER (said AND gold) AS BIGINT) AS tp, CAST(count(*) FILTER (said AND NOT gold) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT said AND gold) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT said AND NOT gold) AS BIGINT) AS tn FROM "
        f"(SELECT t / 20.0::DOUBLE AS tau, answers AND confidence >= t / 20.0::DOUBLE AS said, gold FROM ({rows}), range(1, 20) r(t)) GROUP BY tau"
    )


@query("e19_grader_sweep", "judged", _grades("SELECT k % 2 = 0 AS answers, score AS confidence, relevant AS gold FROM judged WHERE k % 13 <> 0"))
def _(judged):
    """Outcomes of a grader at each threshold; rows it couldn't grade are left out."""
    rows = judged.where("k % 13 <> 0").select((F.col("k") % 2 == 0).alias("answers"), F.col("score").alias("confidence"), F.col("relevant").alias("gold"))
    return M.grade_sweep(rows, [t / 20 for t in range(1, 20)])


@query("e18_contradiction_sweep", "judged", _grades("SELECT k % 3 <> 0 AS answers, score AS confidence, relevant AS gold FROM judged"))
def _(judged):
    rows = judged.select((F.col("k") % 3 != 0).alias("answers"), F.col("score").alias("confidence"), F.col("relevant").alias("gold"))
    return M.grade_sweep(rows, [t / 20 for t in range(1, 20)])


@query(
    "e18_retrieval_distribution", "judged",
    f"SELECT CAST(rank AS INT) AS rank, round(avg(score), 6) AS mean, round(min(score), 6) AS least, CAST(count(*) FILTER (relevant) AS BIGINT) AS hits FROM ({_RANKED}) WHERE rank <= 10 GROUP BY 1",
)
def _(judged):
    """Scores and hits by place in the first ten."""
    top = V.ranked(judged).where("rank <= 10")
    return top.groupBy("rank").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.count_if("relevant").alias("hits"))


@query("e22_permutation_test", "judged")
def _(judged):
    """Chance of a difference of means as large if labels were dealt anew within weeks."""
    week = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "day"), F.weekofyear("day"))
    return M.permutation_test(judged.select("k", week.alias("week"), F.col("relevant").alias("case"), F.col("score").alias("value")), rounds=200)


@query(
    "e23_triggers", "signals",
    "SELECT day, CASE WHEN u >= a AND s < a THEN 'SCOPING-ARTIFACT' WHEN s1 >= 30 AND p >= s1 THEN 'RUN' WHEN late AND s1 >= 15 AND p >= s1 THEN 'RUN' WHEN late AND s1 < 15 AND u < 15 THEN 'PARK-SPARSE' ELSE 'WAIT' END AS decision FROM (SELECT *, CASE WHEN late THEN 15 ELSE 30 END AS a FROM "
    "(SELECT day, day >= DATE '2024-01-20' AS late, count(*) FILTER (event = 'signal.reaction') AS u, count(*) FILTER (event = 'signal.reaction' AND surface <> 'surface0') AS s, count(*) FILTER (event = 'signal.reaction' AND surface = 'surface1') AS s1, count(*) FILTER (event = 'capture.turn') AS p FROM signals GROUP BY day))",
)
def _(signals):
    reacted = F.col("event") == "signal.reaction"
    counts = signals.groupBy("day").agg(
        F.count_if(reacted).alias("unscoped"), F.count_if(reacted & (F.col("surface") != "surface0")).alias("scoped"),
        F.count_if(reacted & (F.col("surface") == "surface1")).alias("cases"), F.count_if(F.col("event") == "capture.turn").alias("pool"),
    )
    return counts.select("day", M.trigger(F.col("scoped"), F.col("cases"), F.col("pool"), F.col("unscoped"), F.col("day") >= F.lit("2024-01-20").cast("date"), 30, 15).alias("decision"))


@query(
    "e24_attribution", "captures",
    "SELECT c.capture_id, c.point_id, CASE WHEN c.seq % 5 = 0 THEN 'event' ELSE 'heuristic' END AS mode, CASE WHEN c.seq % 5 = 0 THEN CASE WHEN c.seq % 2 = 0 THEN 'authored' ELSE 'inherited' END WHEN e.capture_id = c.capture_id AND c.seq % 3 <> 0 THEN 'authored' ELSE 'inherited' END AS class FROM captures c "
    "JOIN (SELECT point_id, arg_min(capture_id, (created_at, capture_id)) AS capture_id FROM captures GROUP BY point_id) e ON e.point_id = c.point_id",
)
def _(captures):
    """Whether a capture wrote a point or came upon it: by its own event, else by being the first that names it near its making."""
    event = F.when(F.col("seq") % 5 == 0, F.when(F.col("seq") % 2 == 0, "ADD").otherwise("DEDUP_MERGED"))
    rows = captures.select("capture_id", "point_id", event.alias("event"), (F.col("seq") % 3 != 0).alias("near"))
    return M.attribution(rows, A.earliest_reference(captures))


@query(
    "e25_distractors", "points",
    "SELECT p.seq AS i, l.lane, concat('template ', CAST((p.seq // n) % 4 AS STRING), ' of ', CAST((p.seq // n) // 4 AS STRING)) AS text FROM points p JOIN (SELECT lane, row_number() OVER (ORDER BY lane) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT lane FROM points WHERE lane IS NOT NULL)) l ON p.seq % n = k",
)
def _(points):
    """A filler for each point, over the lanes that points use: lanes in turn, templates in turn, then the next combination."""
    return M.distractors(points.select(F.col("seq").alias("i")), points, 4)


_COS = "list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) * list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[]))"


@query(
    "e29_twins", "points",
    f"SELECT q.seq, count(p.seq) > 0 AS twin FROM (SELECT * FROM points WHERE seq % 20 = 0) q LEFT JOIN points p ON p.seq <> q.seq AND p.user_id = q.user_id AND {_COS} >= 0.4 GROUP BY q.seq",
)
def _(points):
    """Queries whose target has a near twin, which a recall without twins leaves out; ids divisible by 20 are the queries."""
    near = R.nearest(points, points.where("seq % 20 = 0"), 1, arms=("user_id",), least=0.4).select(F.col("query").alias("seq"), F.lit(True).alias("twin")).distinct()
    return points.where("seq % 20 = 0").select("seq").join(near, "seq", "left").select("seq", F.coalesce("twin", F.lit(False)).alias("twin"))


@query(
    "e31_hard_negatives", "",
    "WITH p AS (SELECT p_partkey AS k, p_brand AS lane, list_distinct(list_filter(string_split_regex(lower(concat(p_name, ' ', p_type)), '[^a-z0-9_]+'), lambda w: w <> '')) AS w FROM part), t AS (SELECT k, lane, unnest(w) AS term FROM p), "
    "m AS (SELECT a.k AS query, b.k AS negative, count(*) AS shared FROM t a JOIN t b ON a.term = b.term AND a.lane = b.lane AND a.k <> b.k WHERE a.k % 20 = 0 GROUP BY ALL) SELECT query, negative, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, negative) AS r FROM m) WHERE r = 1",
)
def _(spark, sf_dir):
    """The row of the same lane with most words in common; ids divisible by 20 are the queries."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.filter(F.split(F.lower(F.concat("p_name", F.lit(" "), "p_type")), "[^a-z0-9_]+"), lambda w: w != "")
    terms = part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("lane"), F.explode(F.array_distinct(words)).alias("term"))
    return M.hard_negatives(terms.where("k % 20 = 0"), terms)


@query(
    "a23_denominators", "captures attached",
    "SELECT verdict, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (capture_id IN (SELECT capture_id FROM attached WHERE n > 0)) AS BIGINT) AS reacted FROM captures GROUP BY verdict",
)
def _(captures, attached):
    """Ledger rows and folded rows by verdict, reacted or not."""
    day = F.to_date("created_at")
    rows = captures.withColumn("day", day).withColumn("old", F.col("created_at").cast("timestamp") < F.lit("2024-01-10 00:00:00").cast("timestamp"))
    hit = attached.where("n > 0").select("capture_id").distinct().withColumn("hit", F.lit(1))
    rows = rows.join(hit, "capture_id", "left")
    live = rows.where("NOT old").groupBy("verdict").agg(F.count("*").alias("n"), F.count("hit").alias("reacted"))
    folded = rows.where("old").groupBy("day", "verdict").agg(F.count("*").alias("n"), F.count("hit").alias("reacted")).drop("day")
    return live.unionByName(folded).groupBy("verdict").agg(F.sum("n").alias("n"), F.sum("reacted").alias("reacted"))


@query(
    "g07_densest", "notes",
    "SELECT * FROM (WITH l AS (SELECT DISTINCT least(note, x) AS src, greatest(note, x) AS dst FROM (SELECT note, a AS x FROM notes UNION ALL SELECT note, b FROM notes) WHERE note <> x AND x IN (SELECT note FROM notes)), "
    "b AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l), r AS (SELECT src AS note, count(*) AS ring FROM b GROUP BY 1), "
    "i AS (SELECT x.src AS note, count(*) AS interlinks FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN l ON l.src = x.dst AND l.dst = y.dst GROUP BY 1), "
    "top AS (SELECT note, CAST(coalesce(interlinks, 0) AS BIGINT) AS interlinks, CAST(ring AS BIGINT) AS ring FROM r LEFT JOIN i USING (note) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1) "
    "SELECT t.note, t.interlinks, t.ring, l.src, l.dst FROM top t, l WHERE (l.src = t.note OR l.src IN (SELECT dst FROM b WHERE b.src = t.note)) AND (l.dst = t.note OR l.dst IN (SELECT dst FROM b WHERE b.src = t.note)))",
)
def _(notes):
    """The note whose neighbours are most linked with one another (then most neighbours, then first), and every edge among it and them."""
    links = notes.select("note", F.col("a").alias("x")).union(notes.select("note", "b"))
    edges = G.undirected(links.join(notes.select(F.col("note").alias("x")), "x").select(F.col("note").alias("src"), F.col("x").alias("dst")))
    return G.densest(edges)


@query(
    "e28_distribution", "judged",
    "SELECT level, round(min(cost), 4) AS least, round(quantile_cont(cost, 0.05), 4) AS p5, round(quantile_cont(cost, 0.25), 4) AS p25, round(quantile_cont(cost, 0.5), 4) AS median, round(quantile_cont(cost, 0.75), 4) AS p75, round(quantile_cont(cost, 0.95), 4) AS p95, round(max(cost), 4) AS most, round(avg(cost), 4) AS mean FROM judged GROUP BY level",
)
def _(judged):
    shares = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    s = judged.groupBy("level").agg(*(F.round(f("cost"), 4).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"))))
    ranks = quantiles(judged, ["level"], "cost", shares, interpolated=True).select("level", *(F.round(n, 4).alias(n) for n in shares))
    return s.join(ranks, "level").select("level", "least", *shares, "most", "mean")


@query(
    "e32_currency_arms", "points",
    "SELECT data, bool_or(status = 'superseded') AS stale, bool_or(coalesce(status, 'current') = 'current') AS current_, NOT coalesce(bool_or(status = 'superseded'), FALSE) AND bool_or(coalesce(status, 'current') = 'current') AS only_current, coalesce(bool_or(status = 'superseded'), FALSE) AND bool_or(coalesce(status, 'current') = 'current') AS both_ FROM points GROUP BY data",
)
def _(points):
    """For each text, whether its stale and its current state are told, one without the other or both."""
    s = points.groupBy("data").agg(F.bool_or(F.col("status") == "superseded").alias("stale"), F.bool_or(F.coalesce("status", F.lit("current")) == "current").alias("current_"))
    stale = F.coalesce("stale", F.lit(False))
    return s.withColumns({"only_current": ~stale & F.col("current_"), "both_": stale & F.col("current_")})
