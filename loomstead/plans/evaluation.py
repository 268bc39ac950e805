"""Evaluation, ranking and maintenance queries over the derived tables, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import attribution as A
from loomstead.operators import recall as R
from loomstead.operators import retrieval as V
from loomstead.plans.memory import query, raw

# ---- Points and their upkeep ------------------------------------------------

RESERVED = ("hash", "userId", "vector")


@query(
    "p18_point_update", "points",
    "SELECT id, CASE WHEN seq % 12 = 0 THEN concat(data, ' revised') ELSE data END AS data, md5(CASE WHEN seq % 12 = 0 THEN concat(data, ' revised') ELSE data END) AS hash, seq % 12 = 0 AS embed_again FROM points",
)
def _(points):
    hit = F.col("seq") % 12 == 0
    data = F.when(hit, F.concat("data", F.lit(" revised"))).otherwise(F.col("data"))
    return points.select("id", data.alias("data"), F.md5(data).alias("hash"), hit.alias("embed_again"))


@query("p19_reserved_guard", "points", "SELECT id, CASE seq % 9 WHEN 0 THEN 'hash' WHEN 4 THEN 'vector' END AS refused FROM points")
def _(points):
    """The reserved key, if any, that a caller's patch of a point names."""
    named = F.element_at(F.array(*map(F.lit, ("hash", "lane", "title", "data", "vector", "score", "project", "persona", "status"))), (F.col("seq") % 9 + 1).cast("int"))
    patch = F.create_map(named, F.lit("x"), F.lit("note"), F.lit("y"))
    held = F.filter(F.map_keys(patch), lambda k: k.isin(*RESERVED))
    return points.select("id", F.get(held, F.lit(0)).alias("refused"))


@query(
    "p20_slug_quarantine", "",
    "SELECT CAST(count(*) FILTER (regexp_full_match(trim(p_type), '[a-zA-Z0-9._-]+')) AS BIGINT) AS good, CAST(count(*) FILTER (NOT regexp_full_match(trim(p_type), '[a-zA-Z0-9._-]+')) AS BIGINT) AS bad FROM part",
)
def _(spark, sf_dir):
    ok = T.blank_to_null(F.col("p_type")).rlike("^[a-zA-Z0-9._-]+$")
    return raw(spark, sf_dir, "part").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@query(
    "x01_merge_set", "points",
    "SELECT id, CASE WHEN project IS NULL OR project = 'proj2' THEN 'proj2,proj9' ELSE concat('proj2,proj9,', project) END AS projects FROM points",
)
def _(points):
    """A project joins an ordered set at its end, once; absent values leave it as it is."""
    old = F.array(F.lit("proj2"), F.lit("proj9"))
    return points.select("id", F.array_join(A.union_set(old, F.col("project")), ",").alias("projects"))


@query(
    "m14_resurrection", "points",
    "SELECT data, CAST(count(*) AS BIGINT) AS rows_, max_by(coalesce(status, 'current'), seq) AS status FROM points GROUP BY data",
)
def _(points):
    # One deterministic id a text: the last assertion wins, whatever state the earlier ones were in.
    s = F.max_by(F.coalesce("status", F.lit("current")), "seq")
    return points.groupBy("data").agg(F.count("*").alias("rows_"), s.alias("status"))


@query(
    "f22_mean_pool", "points",
    "SELECT label, CAST(i AS INT) AS place, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(1, len(vector) + 1)) AS i, unnest(vector)::DOUBLE AS v FROM points) GROUP BY ALL",
)
def _(points):
    each = points.select("label", F.posexplode("vector").alias("i", "v"))
    return each.groupBy("label", (F.col("i") + 1).alias("place")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query(
    "a19_provider_cost", "judged",
    "SELECT level, round(sum(coalesce(k % 1000 / 1000.0::DOUBLE * p.i + k % 300 / 1000.0::DOUBLE * p.o, 0)), 6) AS usd FROM judged LEFT JOIN (VALUES ('lexical', 0.15::DOUBLE, 0.6::DOUBLE), ('oblique', 2.5, 10.0)) p(name, i, o) ON p.name = level GROUP BY level",
)
def _(judged):
    from loomstead.operators.statistics import cost

    prices = judged.sparkSession.createDataFrame([("lexical", 0.15, 0.6), ("oblique", 2.5, 10.0)], "level string, i double, o double")
    j = judged.join(F.broadcast(prices), "level", "left")  # a price list of a few rows
    usd = cost(F.col("k") % 1000, F.col("k") % 300, F.col("i"), F.col("o"))
    return j.groupBy("level").agg(F.round(F.sum(usd), 6).alias("usd"))


@query(
    "a11_layer_freshness", "captures",
    "SELECT surface, max(created_at) AS newest, CAST(coalesce(sum(seq % 500) FILTER (created_at > TIMESTAMP '2024-01-20 00:00:00'), 0) AS BIGINT) AS pending, max(created_at) < TIMESTAMP '2024-01-29 12:00:00' AS stale FROM captures GROUP BY surface",
)
def _(captures):
    cursor = F.lit("2024-01-20 00:00:00").cast("timestamp")
    at = F.col("created_at").cast("timestamp")
    pending = F.coalesce(F.sum(F.when(at > cursor, F.col("seq") % 500)), F.lit(0))
    stale = F.max(at) < F.lit("2024-01-29 12:00:00").cast("timestamp")
    return captures.groupBy("surface").agg(F.max("created_at").alias("newest"), pending.alias("pending"), stale.alias("stale"))


@query(
    "a18_counters_by_label", "signals",
    "SELECT outcome, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM signals GROUP BY outcome",
)
def _(signals):
    return signals.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "a24_retention_start", "captures",
    "SELECT max(CAST(created_at AS DATE)) + 1 AS start FROM captures WHERE verdict = 'abstained' AND created_at < TIMESTAMP '2024-01-15 00:00:00'",
)
def _(captures):
    day = F.to_date("created_at")
    return captures.where("verdict = 'abstained'").where(F.col("created_at").cast("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp")).agg(F.date_add(F.max(day), 1).alias("start"))


# ---- Ranks ------------------------------------------------------------------


@query("w01_ranks", "judged", "SELECT qid, k, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS INT) AS rank FROM judged")
def _(judged):
    return V.ranked(judged).select("qid", "k", "rank")


@query(
    "w02_margin", "judged",
    "SELECT qid, round(max(score) FILTER (r = 1) - max(score) FILTER (r = 2), 9) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS r FROM judged) GROUP BY qid",
)
def _(judged):
    top = V.ranked(judged).where("rank <= 2")
    return top.groupBy("qid").agg(F.round(F.max("score") - F.when(F.count("*") > 1, F.min("score")), 9).alias("margin"))


@query(
    "w03_topk_mean", "judged",
    "SELECT qid, round(avg(score), 9) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS r FROM judged) WHERE r <= 3 GROUP BY qid",
)
def _(judged):
    return V.ranked(judged).where("rank <= 3").groupBy("qid").agg(F.round(F.avg("score"), 9).alias("mean"))


@query("t02_widened_limit", "points", "SELECT id FROM (SELECT * FROM points ORDER BY score DESC NULLS LAST, seq LIMIT 25) WHERE valid_from IS NOT NULL ORDER BY score DESC NULLS LAST, seq LIMIT 5")
def _(points):
    order = (F.col("score").desc_nulls_last(), F.col("seq"))
    base = 5
    wide = max(base, min(base * 5, 50))
    return points.orderBy(*order).limit(wide).where("valid_from IS NOT NULL").orderBy(*order).limit(base).select("id")


# ---- Text -------------------------------------------------------------------


@query(
    "f42_ngram_leak", "",
    "WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '') AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)), "
    "b AS (SELECT DISTINCT array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT w, unnest(generate_series(1, len(w) - 4)) AS i FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '') AS w FROM benchmark) WHERE len(w) >= 5)) "
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS shared FROM g JOIN b USING (gram) GROUP BY doc_id",
)
def _(spark, sf_dir):
    """Distinct runs of five words that a document shares with the benchmark."""
    return V.shared_grams(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "benchmark"), 5)


@query(
    "f44_rare_terms", "",
    "WITH t AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 30)) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM t GROUP BY term) "
    "SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS r FROM t JOIN df USING (term), n WHERE df <= 0.2 * n) WHERE r <= 3",
)
def _(spark, sf_dir):
    docs = raw(spark, sf_dir, "documents")
    t = docs.select("doc_id", F.explode_outer(F.array_distinct(V.tokens(F.col("text")))).alias("term")).where("term IS NOT NULL")
    df = t.groupBy("term").agg(F.count("*").alias("df"))
    whole = docs.agg(F.count("*").alias("n"))  # one row
    rare = df.crossJoin(F.broadcast(whole)).where("df <= 0.2 * n").select("term", "df")  # before the join: common terms never meet it
    met = t.join(rare, "term")
    least = F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, 3)
    return met.groupBy("doc_id").agg(least.alias("l")).select("doc_id", F.explode("l").alias("l")).select("doc_id", F.col("l.term").alias("term"))


@query(
    "g11_identifier_sets", "",
    "SELECT docs, max(ident) AS ident FROM (SELECT ident, array_to_string(list_sort(list(doc_id)), ',') AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9a-f]{40}')) AS ident FROM documents) GROUP BY ident) GROUP BY docs",
)
def _(spark, sf_dir):
    found = raw(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[0-9a-f]{40}"), F.lit(0))).alias("ident")).where("ident IS NOT NULL").distinct()
    sets = found.groupBy("ident").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("docs"))
    return sets.groupBy("docs").agg(F.max("ident").alias("ident"))


# ---- Evaluation -------------------------------------------------------------

_R = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank FROM judged"


@query(
    "e01_recall_at_k", "judged",
    f"SELECT round(avg(h1), 6) AS at_1, round(avg(h5), 6) AS at_5, round(avg(rr), 6) AS mrr FROM (SELECT qid, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS h1, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS h5, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS rr FROM ({_R}) GROUP BY qid)",
)
def _(judged):
    r = V.ranked(judged)
    hit = lambda k: F.max((F.col("relevant") & (F.col("rank") <= k)).cast("double"))
    per = r.groupBy("qid").agg(hit(1).alias("h1"), hit(5).alias("h5"), F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(*(F.round(F.avg(c), 6).alias(n) for c, n in (("h1", "at_1"), ("h5", "at_5"), ("rr", "mrr"))))


def _micro(rows: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall, F1 and F0.5 of predicted against expected labels; null abstains."""
    hit = (F.col("predicted") == F.col("expected")).cast("double")
    s = rows.groupBy(*by).agg(F.sum(F.coalesce(hit, F.lit(0.0))).alias("tp"), F.count("predicted").alias("p"), F.count("expected").alias("e"))
    precision, recall = F.col("tp") / F.col("p"), F.col("tp") / F.col("e")
    return s.select(*by, F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(V.f_beta(precision, recall, 1.0), 6).alias("f1"), F.round(V.f_beta(precision, recall), 6).alias("f05"))


@query(
    "e06_micro_scores", "judged",
    "SELECT level, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(1.25 * p * r / (0.25 * p + r), 6) AS f05 FROM (SELECT level, count(*) FILTER (predicted = expected) / count(predicted)::DOUBLE AS p, count(*) FILTER (predicted = expected) / count(expected)::DOUBLE AS r FROM judged GROUP BY level)",
)
def _(judged):
    return _micro(judged, "level")


@query(
    "e08_rates", "judged",
    "SELECT round(avg(CASE WHEN relevant AND score > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS stale_return, round(count(*) FILTER (score < 0.3 AND NOT relevant) / count(*) FILTER (score < 0.3)::DOUBLE, 6) AS no_answer_precision FROM judged",
)
def _(judged):
    low = F.col("score") < 0.3
    return judged.agg(
        F.round(F.avg((F.col("relevant") & (F.col("score") > 0.5)).cast("double")), 6).alias("stale_return"),
        F.round(F.count_if(low & ~F.col("relevant")) / F.count_if(low), 6).alias("no_answer_precision"),
    )


@query(
    "e10_gates", "judged",
    f"SELECT name, value, value IS NULL OR value < least_ AS breach FROM (SELECT 'recall_at_5' AS name, (SELECT round(avg(h), 6) FROM (SELECT qid, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS h FROM ({_R}) GROUP BY qid)) AS value, 0.96 AS least_ UNION ALL SELECT 'unmeasured', NULL, 0.5)",
)
def _(judged):
    floors = judged.sparkSession.createDataFrame([("recall_at_5", 0.96), ("unmeasured", 0.5)], "name string, least double")
    hit = V.ranked(judged).groupBy("qid").agg(F.max((F.col("relevant") & (F.col("rank") <= 5)).cast("double")).alias("h"))
    values = hit.agg(F.round(F.avg("h"), 6).alias("value")).select(F.lit("recall_at_5").alias("name"), "value")
    return floors.join(values, "name", "left").select("name", "value", (F.col("value").isNull() | (F.col("value") < F.col("least"))).alias("breach"))


@query(
    "e20_gap_by_depth", "judged",
    f"SELECT CAST(least(rank, 10) AS INT) AS depth, round(avg(score), 6) AS mean, CAST(count(*) FILTER (relevant) AS BIGINT) AS survivors FROM ({_R}) GROUP BY 1",
)
def _(judged):
    r = V.ranked(judged)
    return r.groupBy(F.least("rank", F.lit(10)).alias("depth")).agg(F.round(F.avg("score"), 6).alias("mean"), F.count_if("relevant").alias("survivors"))


@query(
    "e21_stratified_draw", "judged",
    "SELECT week, k FROM (SELECT strftime(day, '%G-W%V') AS week, k, relevant, row_number() OVER (PARTITION BY strftime(day, '%G-W%V'), relevant ORDER BY md5(concat('7:', CAST(k AS STRING))), k) AS r, count(*) FILTER (relevant) OVER (PARTITION BY strftime(day, '%G-W%V')) AS cases FROM judged) WHERE NOT relevant AND r <= 2 * cases",
)
def _(judged):
    week = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "day"), F.weekofyear("day"))
    j = judged.withColumn("week", week)
    cases = j.where("relevant").groupBy("week").agg(F.count("*").alias("cases"))
    order = Window.partitionBy("week").orderBy(F.md5(F.concat(F.lit("7:"), F.col("k").cast("string"))), "k")
    return j.where("NOT relevant").withColumn("r", F.row_number().over(order)).join(cases, "week").where("r <= 2 * cases").select("week", "k")


@query(
    "e30_gate_sweep", "judged",
    "SELECT gate, round(count(*) FILTER (score > gate) / count(*)::DOUBLE, 6) AS skip_rate, round(avg(CASE WHEN score > gate OR relevant THEN 1.0 ELSE 0.0 END), 6) AS correct FROM judged, (SELECT unnest([0.4, 0.5, 0.6, 0.7])::DOUBLE AS gate) GROUP BY gate",
)
def _(judged):
    # Four gates are four sums of one pass.
    gates = (0.4, 0.5, 0.6, 0.7)
    sums = [x for i, g in enumerate(gates) for x in (
        F.avg((F.col("score") > g).cast("double")).alias(f"s{i}"), F.avg(((F.col("score") > g) | F.col("relevant")).cast("double")).alias(f"c{i}"))]
    cells = F.array(*(F.struct(F.lit(g).alias("gate"), F.round(f"s{i}", 6).alias("skip_rate"), F.round(f"c{i}", 6).alias("correct")) for i, g in enumerate(gates)))
    return judged.agg(*sums).select(F.explode(cells).alias("x")).select("x.*")


@query(
    "e32_currency", "points",
    "SELECT lane, round(avg(CASE WHEN status = 'superseded' THEN 1.0 ELSE 0.0 END), 3) AS stale, round(avg(CASE WHEN status = 'current' THEN 1.0 ELSE 0.0 END), 3) AS current_, round(avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END), 3) AS neither FROM points GROUP BY lane",
)
def _(points):
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 3)
    s = F.col("status")
    return points.groupBy("lane").agg(rate(s == "superseded").alias("stale"), rate(s == "current").alias("current_"), rate(s.isNull()).alias("neither"))


@query(
    "e33_projected_policy", "points",
    "SELECT user_id, CAST(count(*) FILTER (r <= 5 AND valid_from IS NULL) AS BIGINT) AS undated_in_top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN valid_from IS NULL THEN score * 0.9 ELSE score END DESC NULLS LAST, seq) AS r FROM points) GROUP BY user_id",
)
def _(points):
    score = F.when(F.col("valid_from").isNull(), F.col("score") * 0.9).otherwise(F.col("score"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(score.desc_nulls_last(), "seq"))
    top = points.withColumn("r", r)
    return top.groupBy("user_id").agg(F.count_if((F.col("r") <= 5) & F.col("valid_from").isNull()).alias("undated_in_top"))


@query(
    "m07_contradiction_candidates", "points",
    "SELECT query, seq FROM (SELECT q.seq AS query, p.seq AS seq, row_number() OVER (PARTITION BY q.seq ORDER BY list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) * list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) DESC, p.seq) AS r, "
    "list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) AS s FROM points q JOIN points p ON q.seq <> p.seq AND q.user_id = p.user_id AND q.lane = p.lane AND q.persona IS NOT DISTINCT FROM p.persona WHERE q.seq % 20 = 0 AND q.lane IS NOT NULL AND p.status IS DISTINCT FROM 'superseded') WHERE r = 1 AND s >= 0.1",
)
def _(points):
    """Facts without a lane have no candidates; of the ten nearest, the one the judge is surest of is kept (here: the nearest)."""
    laned = points.where("lane IS NOT NULL")
    near = R.nearest(laned.where(R.not_superseded()), laned.where("seq % 20 = 0"), 10, arms=("user_id", "lane", "persona"), least=0.1)
    return near.groupBy("query").agg(F.max_by("seq", F.struct("score", (-F.col("seq")).alias("x"))).alias("seq"))


@query(
    "m15_reaction_attach", "reactions captures",
    "SELECT point_id, CAST(sum(n) AS BIGINT) AS total FROM (SELECT r.n, c.point_id, row_number() OVER (PARTITION BY r.message_id ORDER BY (c.run_id IS NULL), (c.created_at < r.ts), abs(epoch_us(c.created_at) - epoch_us(r.ts)), c.capture_id) AS k FROM reactions r JOIN captures c ON c.user_id = r.user_id "
    "AND (c.run_id IS NULL OR c.run_id = r.run_id) AND c.created_at >= r.ts - INTERVAL 120 SECOND AND c.created_at <= r.ts + INTERVAL 24 HOUR) WHERE k = 1 GROUP BY point_id HAVING sum(n) > 0",
)
def _(reactions, captures):
    placed = A.asof_reactions(reactions, captures).where("capture_id IS NOT NULL")
    met = placed.join(reactions.select("message_id", "n"), "message_id").join(captures.select("capture_id", "point_id"), "capture_id")
    return met.groupBy("point_id").agg(F.sum("n").alias("total")).where("total > 0")
