"""The memory engine's queries over the derived tables, each with SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import attribution as A
from loomstead.operators import graph as G
from loomstead.operators import recall as R
from loomstead.operators import retrieval as V
from loomstead.operators import statistics as S
from loomstead.operators.scan import running
from loomstead.plans.tables import derived, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TODAY, NOW = "2024-01-28", "2024-01-30 06:30:00"
RECALLABLE = "NOT COALESCE(status IN ('superseded', 'deprecated', 'rejected'), FALSE) AND invalidated_at IS NULL"


def query(name: str, tables: str = "", sql: str | None = None):
    """Registers a query; its function gets the derived tables by name order."""

    def add(f: Callable[..., DataFrame]):
        names = tables.split()
        QUERIES[name] = lambda spark, sf_dir: f(*(derived(spark, sf_dir, t) for t in names)) if names else f(spark, sf_dir)
        if sql:
            ORACLES[name] = with_sql(tables, sql)
        return f

    return add


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- Scans, listings, filters ----------------------------------------------


@query("s01_scoped_scan", "points", "SELECT id, data, hash FROM points WHERE user_id = 'u1' ORDER BY seq LIMIT 100")
def _(points):
    return R.scoped_scan(points, "u1").select("id", "data", "hash")


@query("s03_saturation_guard", "points", "SELECT CAST(count(*) AS BIGINT) AS n FROM points WHERE user_id = 'u2' AND lane = 'lane1'")
def _(points):
    return R.assert_unsaturated(points.where("user_id = 'u2' AND lane = 'lane1'"), 10_000_000).agg(F.count("*").alias("n"))


@query(
    "s04_point_projection", "points",
    "SELECT id, data, hash, lane AS m_lane, project AS m_project, CAST(label AS STRING) AS m_label, "
    "CAST(12 + (user_id IS NOT NULL)::INT * 0 - (lane IS NULL)::INT - (persona IS NULL)::INT - (project IS NULL)::INT - (status IS NULL)::INT - (invalidated_at IS NULL)::INT "
    "- (superseded_by IS NULL)::INT - (superseded_at IS NULL)::INT - (valid_from IS NULL)::INT - (doc_id IS NULL)::INT - (title IS NULL)::INT - (score IS NULL)::INT + 1 AS INT) AS n_keys FROM points",
)
def _(points):
    p = R.project_point(points)
    get = lambda k: F.element_at("metadata", k)
    return p.select("id", "data", "hash", get("lane").alias("m_lane"), get("project").alias("m_project"), get("label").alias("m_label"), F.size("metadata").alias("n_keys"))


@query(
    "s13_counter_rollup", "signals",
    "SELECT day, surface, project, event, outcome, CAST(count(*) AS BIGINT) AS n FROM signals GROUP BY ALL",
)
def _(signals):
    return S.counters(signals)


@query(
    "s15_latest_per_key", "points",
    "SELECT data, user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY data ORDER BY seq DESC) AS r FROM points) WHERE r = 1",
)
def _(points):
    return A.latest(points, "data", "seq").select("data", "user_id", "seq")


@query(
    "s16_payload_patch", "points",
    "SELECT id, CASE WHEN seq % 10 = 0 THEN 'patched' ELSE project END AS project, CASE WHEN seq % 10 = 0 THEN NULL ELSE title END AS title FROM points",
)
def _(points):
    patches = points.where("seq % 10 = 0").select("id", F.lit("patched").alias("new_project"), F.lit(True).alias("clear_title"))
    p = points.join(patches, "id", "left")
    return p.select("id", F.coalesce("new_project", "project").alias("project"), F.when(~F.coalesce("clear_title", F.lit(False)), F.col("title")).alias("title"))


@query(
    "s17_keyset_page", "",
    "SELECT o.o_orderkey, c.c_name, n.n_name, epoch(o.o_orderdate)::BIGINT AS placed FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey "
    "WHERE epoch(o.o_orderdate)::BIGINT > 757382400 OR (epoch(o.o_orderdate)::BIGINT = 757382400 AND o.o_orderkey > 100) ORDER BY placed, o_orderkey LIMIT 50",
)
def _(spark, sf_dir):
    o = raw(spark, sf_dir, "orders").withColumn("placed", F.unix_timestamp("o_orderdate"))
    page = o.where("placed > 757382400 OR (placed = 757382400 AND o_orderkey > 100)").orderBy("placed", "o_orderkey").limit(50)
    # A left join keeps its left rows and their keys are unique on the right, so the page is cut before the joins.
    c, n = raw(spark, sf_dir, "customer"), raw(spark, sf_dir, "nation")
    j = page.join(c, page.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select("o_orderkey", "c_name", "n_name", "placed").orderBy("placed", "o_orderkey")


@query(
    "s22_manifest_checks", "points",
    "SELECT data AS id, CAST(count(*) AS BIGINT) AS n FROM points WHERE data IS NOT NULL GROUP BY data HAVING count(*) > 1",
)
def _(points):
    return points.where("data IS NOT NULL").groupBy(F.col("data").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("s23_snapshot_union", "points notes", "SELECT id AS k FROM points UNION ALL SELECT note AS k FROM notes")
def _(points, notes):
    return points.select(F.col("id").alias("k")).unionByName(notes.select(F.col("note").alias("k")))


@query("s24_resume", "points", "SELECT id FROM points WHERE id NOT IN (SELECT id FROM points WHERE seq % 3 = 0)")
def _(points):
    return A.resume(points, points.where("seq % 3 = 0"), "id").select("id")


@query("s27_recent", "points", "SELECT id, valid_from FROM points WHERE project = 'proj3' ORDER BY valid_from DESC NULLS LAST, id LIMIT 10")
def _(points):
    return points.where("project = 'proj3'").orderBy(F.col("valid_from").desc_nulls_last(), "id").limit(10).select("id", "valid_from")


@query("s28_state_lookup", "points", "SELECT 'nowhere' AS project, max(data) AS state FROM points WHERE project = 'nowhere'")
def _(points):
    one = points.sparkSession.range(1).select(F.lit("nowhere").alias("project"))
    return one.join(points.groupBy("project").agg(F.max("data").alias("state")), "project", "left")


@query("s29_list_all", "points", "SELECT id, data FROM points WHERE doc_id IS DISTINCT FROM '_embedding_stamp' ORDER BY seq LIMIT 100")
def _(points):
    return points.where(R.not_system()).orderBy("seq").limit(R.LIST_LIMIT).select("id", "data")


@query("p01_recallable", "points", f"SELECT id FROM points WHERE {RECALLABLE}")
def _(points):
    return points.where(R.recallable()).select("id")


@query("p02_candidates", "points", "SELECT id FROM points WHERE status IS DISTINCT FROM 'superseded'")
def _(points):
    return points.where(R.not_superseded()).select("id")


@query("p03_partition_arm", "points", "SELECT id FROM points WHERE lane IS NOT DISTINCT FROM NULL AND persona IS NOT DISTINCT FROM 'persona1'")
def _(points):
    return points.where(R.same_arm("lane", None) & R.same_arm("persona", "persona1")).select("id")


@query("p04_system_docs", "points", "SELECT CAST(count(*) AS BIGINT) AS n FROM points WHERE doc_id IS DISTINCT FROM '_embedding_stamp'")
def _(points):
    return points.where(R.not_system()).agg(F.count("*").alias("n"))


@query(
    "p05_post_filters", "points",
    "SELECT id FROM (SELECT * FROM points ORDER BY score DESC NULLS LAST, seq LIMIT 200) WHERE lane = 'lane1' AND project = 'proj4'",
)
def _(points):
    top = points.orderBy(F.col("score").desc_nulls_last(), "seq").limit(200)
    return top.where("lane = 'lane1' AND project = 'proj4'").select("id")


@query(
    "p06_superseded_listing", "points",
    "SELECT id, superseded_at FROM points WHERE status = 'superseded' AND lane = 'lane0' ORDER BY superseded_at DESC NULLS LAST, id LIMIT 20 OFFSET 3",
)
def _(points):
    return R.superseded_listing(points, lane="lane0", limit=20, offset=3).select("id", "superseded_at")


@query(
    "p09_filter_dsl", "points",
    "SELECT id FROM points WHERE (user_id = 'u1' AND lane = 'lane0') OR (project = 'proj5')",
)
def _(points):
    return points.where(R.parse_filters({"OR": [{"user_id": "u1", "lane": "lane0"}, {"project": "proj5"}, {}]})).select("id")


@query(
    "p11_compact_snippets", "",
    "SELECT CAST(doc_id AS STRING) AS id, concat(lang, ' — ', CASE WHEN length(trim(text)) > 240 THEN concat(substr(trim(text), 1, 240), '…') ELSE trim(text) END) AS snippet FROM documents",
)
def _(spark, sf_dir):
    d = raw(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), R.snippet(F.col("lang"), F.col("text")).alias("snippet"))


@query(
    "p10_compact_points", "points",
    "SELECT coalesce(doc_id, id) AS id, coalesce(nullif(title, ''), doc_id, '(untitled)') AS title, concat(coalesce(nullif(title, ''), doc_id, '(untitled)'), ' — ', data) AS snippet FROM points",
)
def _(points):
    return R.compact(points)


@query(
    "p13_event_mapping", "points",
    "SELECT id, CASE status WHEN 'current' THEN 'ADD' WHEN 'superseded' THEN 'UPDATE' ELSE 'NONE' END AS event FROM points",
)
def _(points):
    names = F.create_map(F.lit("current"), F.lit("ADD"), F.lit("superseded"), F.lit("UPDATE"))
    return points.select("id", F.coalesce(F.element_at(names, F.coalesce("status", F.lit(""))), F.lit("NONE")).alias("event"))


@query(
    "p14_compat_search", "points",
    f"SELECT id FROM (SELECT * FROM points ORDER BY score DESC NULLS LAST, seq LIMIT 300) WHERE {RECALLABLE} AND user_id = 'u0' AND (score IS NULL OR score >= 0.3) ORDER BY score DESC NULLS LAST, seq LIMIT 10",
)
def _(points):
    order = (F.col("score").desc_nulls_last(), F.col("seq"))
    top = points.orderBy(*order).limit(300).where(R.recallable() & R.parse_filters({"user_id": "u0"}))
    return top.where("score IS NULL OR score >= 0.3").orderBy(*order).limit(10).select("id")


@query("p15_paging", "points", "SELECT id FROM points ORDER BY seq LIMIT 100 OFFSET 200")
def _(points):
    return points.orderBy("seq").offset(200).limit(100).select("id")


@query("p16_scoped_delete", "points", "SELECT id FROM points WHERE NOT coalesce(user_id = 'u1' AND lane = 'lane2', FALSE)")
def _(points):
    return points.where(~F.coalesce((F.col("user_id") == "u1") & (F.col("lane") == "lane2"), F.lit(False))).select("id")


@query("p17_entity_count", "points", f"SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM points WHERE {RECALLABLE} GROUP BY user_id")
def _(points):
    return points.where(R.recallable()).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "p21_default_project", "points",
    "SELECT id, coalesce(nullif(trim(project), ''), 'default') AS project, substr(coalesce(nullif(trim(lower(title)), ''), lane, 'unknown'), 1, 64) AS surface FROM points",
)
def _(points):
    return points.select("id", T.default_project(F.col("project")).alias("project"), T.surface(F.col("title"), F.col("lane")).alias("surface"))


@query(
    "p23_reaction_normalise", "reactions",
    "SELECT message_id, CASE WHEN n >= 1 THEN least(n * 700, 1000) END AS n, CASE WHEN n >= 1 THEN substr(repeat(kind, 20), 1, 64) END AS kind, CASE WHEN n >= 1 THEN array_to_string(list_slice([kind, '', concat(kind, '+')], 1, 2), '|') END AS kinds FROM reactions",
)
def _(reactions):
    """Counts are capped at 1000, labels at 64 characters and lists at their limit (here 2)."""
    ok = F.col("n") >= 1
    kinds = F.slice(F.array("kind", F.lit(""), F.concat("kind", F.lit("+"))), 1, 2)
    return reactions.select(
        "message_id", F.when(ok, F.least(F.col("n") * 700, F.lit(1000))).alias("n"), F.when(ok, F.substring(F.repeat("kind", 20), 1, 64)).alias("kind"),
        F.when(ok, F.array_join(kinds, "|")).alias("kinds"),
    )


@query(
    "p26_project_slug", "",
    "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
)
def _(spark, sf_dir):
    return raw(spark, sf_dir, "part").select("p_partkey", T.project_slug(F.col("p_name")).alias("slug"))


# ---- Joins ------------------------------------------------------------------


@query(
    "j01_exact_duplicates", "points",
    "SELECT f.seq, p.duplicate_of FROM points f LEFT JOIN (SELECT user_id, hash, lane, persona, min(seq) AS duplicate_of FROM points WHERE status IS DISTINCT FROM 'superseded' GROUP BY ALL) p "
    "ON f.user_id = p.user_id AND f.hash = p.hash AND f.lane IS NOT DISTINCT FROM p.lane AND f.persona IS NOT DISTINCT FROM p.persona",
)
def _(points):
    return A.exact_duplicates(points, points)


_SCORED = (
    "SELECT q.seq AS query, p.seq AS seq, list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) "
    "* list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) AS score FROM points q JOIN points p ON q.seq <> p.seq"
)


@query(
    "j03_similarity_topk", "points",
    f"SELECT query, seq, round(score, 5) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS r FROM ({_SCORED} AND q.seq % 20 = 0 "
    "AND q.user_id = p.user_id AND q.lane IS NOT DISTINCT FROM p.lane AND p.status IS DISTINCT FROM 'superseded') WHERE score >= 0.05) WHERE r <= 10",
)
def _(points):
    near = R.nearest(points.where(R.not_superseded()), points.where("seq % 20 = 0"), 10, arms=("user_id", "lane"), least=0.05)
    return near.select("query", "seq", F.round("score", 5).alias("score"), "rank")


@query(
    "j02_similarity_top1", "points",
    f"SELECT query, seq, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, seq) AS r FROM ({_SCORED} AND q.seq % 20 = 0)) WHERE r = 1",
)
def _(points):
    return R.nearest(points, points.where("seq % 20 = 0"), 1).select("query", "seq", F.round("score", 5).alias("score"))


@query(
    "s02_knn", "points",
    "SELECT p.seq, round(list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) * list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])), 5) AS score "
    "FROM points q, points p WHERE q.seq = 7 ORDER BY score DESC, p.seq LIMIT 20",
)
def _(points):
    one = points.where("seq = 7").select("vector").first()
    return R.search(points, list(one.vector), k=20).select("seq", F.round("score", 5).alias("score"))


@query(
    "j04_asof_reactions", "reactions captures",
    "SELECT message_id, capture_id FROM (SELECT r.message_id, c.capture_id, row_number() OVER (PARTITION BY r.message_id ORDER BY (c.capture_id IS NULL), (c.run_id IS NULL), (c.created_at < r.ts), "
    "abs(epoch_us(c.created_at) - epoch_us(r.ts)), c.capture_id) AS k FROM reactions r LEFT JOIN captures c ON c.user_id = r.user_id AND (c.run_id IS NULL OR c.run_id = r.run_id) "
    "AND c.created_at >= r.ts - INTERVAL 120 SECOND AND c.created_at <= r.ts + INTERVAL 24 HOUR) WHERE k = 1",
)
def _(reactions, captures):
    return A.asof_reactions(reactions, captures)


@query(
    "j05_hash_fallback", "points",
    "SELECT r.ref_id, coalesce(d.seq, h.seq) AS seq FROM (SELECT CASE WHEN seq % 4 = 0 THEN concat('lost', CAST(seq AS STRING)) ELSE id END AS ref_id, user_id, hash FROM points) r "
    "LEFT JOIN points d ON d.id = r.ref_id LEFT JOIN (SELECT user_id, hash, min(seq) AS seq FROM points GROUP BY ALL) h ON h.user_id = r.user_id AND h.hash = r.hash",
)
def _(points):
    refs = points.select(F.when(F.col("seq") % 4 == 0, F.concat(F.lit("lost"), F.col("seq").cast("string"))).otherwise(F.col("id")).alias("ref_id"), "user_id", "hash")
    return A.resolve_by_hash(refs, points)


@query(
    "j06_pointer_chase", "points",
    "SELECT * FROM (WITH RECURSIVE walk(id, place, status, nxt, hops) AS (SELECT id, id, status, superseded_by, 0 FROM points UNION ALL SELECT w.id, p.id, p.status, p.superseded_by, w.hops + 1 "
    "FROM walk w JOIN points p ON p.id = w.nxt WHERE w.status = 'superseded' AND w.hops < 8) SELECT id, max(CASE WHEN status IS DISTINCT FROM 'superseded' THEN place END) AS terminal FROM walk GROUP BY id)",
)
def _(points):
    return A.chase(points)


@query(
    "j08_prunable", "captures attached",
    "SELECT capture_id FROM captures WHERE capture_id NOT IN (SELECT capture_id FROM attached WHERE n > 0) AND capture_id NOT IN (SELECT capture_id FROM attached WHERE point_id <> 'p1')",
)
def _(captures, attached):
    return A.prunable(captures, attached.where("n > 0"), attached.where("point_id <> 'p1'")).select("capture_id")


@query(
    "j10_aliases", "notes",
    "SELECT l.note AS src, m.note AS dst FROM (SELECT note, a AS target FROM notes UNION ALL SELECT note, b FROM notes WHERE b IS NOT NULL) l JOIN "
    "(SELECT lower(alias) AS name, min_by(note, k) AS note FROM notes GROUP BY 1) m ON m.name = lower(l.target)",
)
def _(notes):
    return _edges(notes)


_SPELT = "CASE k % 4 WHEN 0 THEN concat('Note-', k) WHEN 1 THEN concat('note_', k) WHEN 2 THEN concat('My-', k, '_x') ELSE concat('N', k) END"


@query(
    "j10_spellings", "notes",
    f"SELECT * FROM (WITH n AS (SELECT {_SPELT} AS key, CASE WHEN k % 5 = 0 THEN concat('File_', k, '-y.md') ELSE concat({_SPELT}, '.md') END AS file, k, a FROM notes), "
    "s AS (SELECT key, unnest([lower(key), lower(replace(key, '-', '_')), lower(replace(key, '_', '-')), lower(replace(file, '.md', '')), lower(replace(replace(file, '.md', ''), '-', '_')), lower(replace(replace(file, '.md', ''), '_', '-'))]) AS name FROM n), "
    "m AS (SELECT name, min(key) AS dst FROM s GROUP BY 1), "
    "l AS (SELECT key AS src, CASE k % 3 WHEN 0 THEN upper(concat('note-', k + 4 - k % 4)) WHEN 1 THEN concat('my_', k + 2, '-X') ELSE concat('file-', k + 5 - k % 5, '_Y') END AS target FROM n) "
    "SELECT l.src, l.target, coalesce(a.dst, b.dst, c.dst) AS dst FROM l LEFT JOIN m a ON a.name = lower(l.target) LEFT JOIN m b ON b.name = lower(replace(l.target, '-', '_')) LEFT JOIN m c ON c.name = lower(replace(l.target, '_', '-')))",
)
def _(notes):
    """Links find notes by six spellings of their key and file; null where none fits."""
    n = notes.selectExpr(f"{_SPELT} AS key", f"CASE WHEN k % 5 = 0 THEN concat('File_', k, '-y.md') ELSE concat({_SPELT}, '.md') END AS file", "k")
    links = n.selectExpr("key AS src", "CASE k % 3 WHEN 0 THEN upper(concat('note-', k + 4 - k % 4)) WHEN 1 THEN concat('my_', k + 2, '-X') ELSE concat('file-', k + 5 - k % 5, '_Y') END AS target")
    met, lost = G.resolve_spellings(links, n)
    named = links.join(met.distinct(), "src", "left")
    return named.select("src", "target", "dst")


def _edges(notes: DataFrame) -> DataFrame:
    links = notes.select(F.col("note").alias("src"), F.col("a").alias("target")).union(notes.where("b IS NOT NULL").select("note", "b"))
    return G.resolve_links(links, notes.select("alias", "note", F.col("k").alias("order")))[0]


@query(
    "j11_reacted_classes", "captures attached",
    "SELECT class, CAST(count(*) AS BIGINT) AS n FROM (SELECT c.capture_id, CASE WHEN t.total IS NULL THEN 'unreacted' WHEN t.total > 0 THEN 'reacted' ELSE 'zeroed' END AS class FROM captures c "
    "LEFT JOIN (SELECT capture_id, sum(n) AS total FROM attached GROUP BY 1) t USING (capture_id)) GROUP BY class",
)
def _(captures, attached):
    return A.classify_reacted(captures, attached).groupBy("class").agg(F.count("*").alias("n"))


@query(
    "j12_earliest_reference", "captures",
    "SELECT point_id, capture_id FROM (SELECT point_id, capture_id, row_number() OVER (PARTITION BY point_id ORDER BY created_at, capture_id) AS r FROM captures) WHERE r = 1",
)
def _(captures):
    return A.earliest_reference(captures)


@query(
    "j13_user_override", "points",
    "SELECT id, CASE WHEN seq % 6 = 0 THEN 'by user' ELSE status END AS status FROM points",
)
def _(points):
    return A.override(points, points.where("seq % 6 = 0").select("id", F.lit("by user").alias("status")), "id", "status").select("id", "status")


# ---- Statistics -------------------------------------------------------------


@query("a01_last_seen", "signals", "SELECT surface, max(day) AS last_day FROM signals WHERE event LIKE 'capture.%' GROUP BY surface")
def _(signals):
    return S.last_seen(S.counters(signals))


_SEVEN = f"day BETWEEN DATE '{TODAY}' - 6 AND DATE '{TODAY}'"


@query(
    "a02_window_counts", "signals",
    f"SELECT surface, CAST(count(*) AS BIGINT) AS events_7d, CAST(count(*) FILTER (day = DATE '{TODAY}') AS BIGINT) AS events_today, "
    f"CAST(count(*) FILTER (day = DATE '{TODAY}' AND outcome IN ('error', 'failed')) AS BIGINT) AS errors_today FROM signals WHERE {_SEVEN} GROUP BY surface",
)
def _(signals):
    return S.window_counts(S.counters(signals), TODAY)


@query(
    "a03_outcomes_7d", "signals",
    "SELECT surface, " + ", ".join(f"CAST(count(*) FILTER (outcome = '{o}') AS BIGINT) AS {o}" for o in S.OUTCOMES)
    + f" FROM signals WHERE {_SEVEN} AND event IN ('capture.extraction', 'capture.checkpoint') GROUP BY surface",
)
def _(signals):
    return S.outcomes(S.counters(signals), TODAY)


def _event_sums(event: str) -> str:
    return (
        f"SELECT surface, CAST(count(*) AS BIGINT) AS n_7d, CAST(count(*) FILTER (day = DATE '{TODAY}') AS BIGINT) AS n_today FROM signals WHERE {_SEVEN} AND event = '{event}' GROUP BY surface"
    )


@query("a04_turns_7d", "signals", _event_sums("capture.turn"))
def _(signals):
    return S.event_sums(S.counters(signals), TODAY, "capture.turn")


@query("a07_searches_7d", "signals", _event_sums("recall.search"))
def _(signals):
    return S.event_sums(S.counters(signals), TODAY, "recall.search")


def _growth(event: str, kept: str) -> str:
    return (
        f"SELECT CAST(d.day AS DATE) AS day, CAST(count(s.event) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '{TODAY}' - 6, DATE '{TODAY}', INTERVAL 1 DAY)) AS day) d "
        f"LEFT JOIN signals s ON s.day = CAST(d.day AS DATE) AND s.event = '{event}' AND s.outcome IN ({kept}) GROUP BY 1"
    )


@query("a05_growth_facts", "signals", _growth("capture.extraction", "'stored', 'superseded'"))
def _(signals):
    return S.growth(S.counters(signals), TODAY, "capture.extraction", ("stored", "superseded"))


@query("a06_growth_docs", "signals", _growth("capture.checkpoint", "'stored', 'error'"))
def _(signals):
    return S.growth(S.counters(signals), TODAY, "capture.checkpoint", ("stored", "error"))


@query(
    "a08_reactions_7d", "signals",
    f"SELECT surface, outcome, CAST(count(*) AS BIGINT) AS n FROM signals WHERE {_SEVEN} AND event = 'signal.reaction' AND outcome IN ('stored', 'abstained') "
    "AND surface IN (SELECT surface FROM signals WHERE event LIKE 'capture.%') GROUP BY ALL",
)
def _(signals):
    c = S.counters(signals)
    r = c.where(S._window(F.col("day"), TODAY) & (F.col("event") == "signal.reaction") & F.col("outcome").isin("stored", "abstained"))
    return r.join(S.last_seen(c).select("surface"), "surface", "left_semi").groupBy("surface", "outcome").agg(F.sum("n").alias("n"))


@query(
    "a09_freshness_hours", "signals",
    f"SELECT surface, round(greatest((epoch(TIMESTAMP '{NOW}') - epoch(max(day) + INTERVAL 1 DAY)) / 3600.0, 0.0), 1) AS hours FROM signals WHERE event LIKE 'capture.%' GROUP BY surface",
)
def _(signals):
    return S.last_seen(S.counters(signals)).select("surface", S.freshness_hours(F.col("last_day"), NOW).alias("hours"))


@query("a10_corpus_by_project", "points", "SELECT coalesce(nullif(trim(project), ''), '(unknown)') AS project, CAST(count(*) AS BIGINT) AS n FROM points WHERE doc_id IS DISTINCT FROM '_embedding_stamp' GROUP BY 1")
def _(points):
    return S.corpus_by_project(points.where(R.not_system()))


@query(
    "a12_point_reactions", "attached",
    "SELECT t.point_id, reaction_count, kinds FROM (SELECT l.point_id, CAST(sum(s.n) AS BIGINT) AS reaction_count FROM (SELECT DISTINCT point_id, capture_id FROM attached) l JOIN "
    "(SELECT capture_id, message_id, max_by(n, seq) AS n FROM attached GROUP BY ALL) s USING (capture_id) GROUP BY 1) t JOIN "
    "(SELECT point_id, string_agg(kind, ',' ORDER BY f, message_id) AS kinds FROM (SELECT point_id, kind, f, message_id, row_number() OVER (PARTITION BY point_id, kind ORDER BY f, message_id) AS k FROM "
    "(SELECT point_id, capture_id, min(seq) AS f FROM attached GROUP BY ALL) JOIN (SELECT capture_id, message_id, max_by(kind, seq) AS kind FROM attached GROUP BY ALL) USING (capture_id)) WHERE k = 1 GROUP BY point_id) u ON u.point_id = t.point_id",
)
def _(attached):
    return A.point_reactions(attached)


@query(
    "a13_tally_fold", "captures",
    "SELECT CAST(created_at AS DATE) AS day, user_id, surface, verdict, CAST(count(*) AS BIGINT) AS n FROM captures GROUP BY ALL",
)
def _(captures):
    rows = captures.withColumn("day", F.to_date("created_at"))
    old = rows.where("seq % 2 = 0").groupBy("day", "user_id", "surface", "verdict").agg(F.count("*").alias("n"))
    return S.fold_tally(old, rows.where("seq % 2 = 1"))


@query(
    "a14_latency_percentiles", "signals",
    "SELECT surface, CAST(count(value) AS BIGINT) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM signals GROUP BY surface",
)
def _(signals):
    return S.distribution(signals, F.col("value"), "surface")


@query(
    "a16_prevalence", "signals",
    "SELECT day, round(count(*) FILTER (outcome <> 'odd') / count(*)::DOUBLE, 6) AS prevalence FROM signals WHERE event = 'recall.search' GROUP BY day",
)
def _(signals):
    """Of each day's searches, the share with a temporal kind (an outcome other than 'odd' stands for one)."""
    return signals.where("event = 'recall.search'").groupBy("day").agg(F.round(F.avg((F.col("outcome") != "odd").cast("double")), 6).alias("prevalence"))


@query(
    "a17_histogram", "signals",
    "SELECT surface, " + ", ".join(f"CAST(count(*) FILTER (value <= {b}) AS BIGINT) AS le_{str(b).replace('.', '_')}" for b in (1.0, 5.0, 25.0, 100.0)) + ", CAST(count(*) AS BIGINT) AS n FROM signals GROUP BY surface",
)
def _(signals):
    return S.histogram(signals, F.col("value"), (1.0, 5.0, 25.0, 100.0), "surface")


@query("a20_daily_cap", "judged", "SELECT day, expected AS project, round(sum(cost), 4) AS spent, round(sum(cost), 4) >= 200000 AS stop FROM judged GROUP BY ALL")
def _(judged):
    return S.over_budget(judged.withColumnRenamed("expected", "project"), 200_000)


@query(
    "a22_confusion", "judged",
    "SELECT e.expected, p.predicted, CAST(count(j.e) AS BIGINT) AS n FROM (SELECT DISTINCT coalesce(expected, '(none)') AS expected FROM judged) e CROSS JOIN (SELECT DISTINCT coalesce(predicted, '(none)') AS predicted FROM judged) p "
    "LEFT JOIN (SELECT coalesce(expected, '(none)') AS e, coalesce(predicted, '(none)') AS p FROM judged) j ON j.e = e.expected AND j.p = p.predicted GROUP BY ALL",
)
def _(judged):
    return S.confusion(judged)


@query(
    "p28_freshness_verdict", "signals",
    f"SELECT surface, hours, CASE WHEN hours <= 24 THEN 'FRESH' ELSE 'STALE' END AS verdict FROM (SELECT surface, round(greatest((epoch(TIMESTAMP '{NOW}') - epoch(max(day) + INTERVAL 1 DAY)) / 3600.0, 0.0), 1) AS hours "
    "FROM signals WHERE event LIKE 'capture.%' GROUP BY surface ORDER BY hours, surface LIMIT 1)",
)
def _(signals):
    return S.freshness_verdict(S.last_seen(S.counters(signals)), NOW, 24)


# ---- Functions --------------------------------------------------------------


@query(
    "f10_temporal_decay", "points",
    "SELECT id, round(CASE WHEN valid_from IS NOT NULL THEN CASE WHEN coalesce(score, 0) = 0 THEN 1.0 ELSE score END * least(1.0, exp(-((epoch_ms(TIMESTAMP '2024-06-15 00:00:00') - epoch_ms(CAST(valid_from AS TIMESTAMP))) / 86400000.0) / 30.0)) "
    "ELSE score * exp(-0.25) END, 9) AS decayed FROM points",
)
def _(points):
    return R.temporal_decay(points, 1718409600000).select("id", F.round("decayed", 9).alias("decayed"))


@query(
    "f11_temporal_window", "points",
    "SELECT id, round(CASE WHEN valid_from IS NULL THEN score * 0.8 WHEN t BETWEEN 1709251200000 AND 1714521599999 THEN score ELSE score * greatest(exp(-(CASE WHEN t < 1709251200000 THEN 1709251200000 - t ELSE t - 1714521599999 END / 86400000.0) / 30.0), 0.05) END, 9) AS windowed "
    "FROM (SELECT *, epoch_ms(CAST(valid_from AS TIMESTAMP)) AS t FROM points)",
)
def _(points):
    return R.temporal_window(points, 1709251200000, 1714521599999).select("id", F.round("windowed", 9).alias("windowed"))


@query(
    "f23_prototypes", "points",
    "SELECT seq, lane FROM (SELECT seq, lane, s, row_number() OVER (PARTITION BY seq ORDER BY s DESC, lane) AS r, lead(s) OVER (PARTITION BY seq ORDER BY s DESC, lane) AS nxt FROM (SELECT seq, lane, avg(score) AS s FROM "
    "(SELECT f.seq, CAST(e.label AS STRING) AS lane, list_dot_product(f.vector::DOUBLE[], e.vector::DOUBLE[]) AS score, row_number() OVER (PARTITION BY f.seq, e.label ORDER BY list_dot_product(f.vector::DOUBLE[], e.vector::DOUBLE[]) DESC) AS k "
    "FROM points f, points e WHERE e.seq < 60) WHERE k <= 3 GROUP BY ALL)) WHERE r = 1 AND s >= 0.30 AND s - nxt >= 0.08",
)
def _(points):
    # The exemplars are a fixed taxonomy: no more than 60 of them, whatever the number of facts.
    protos = points.where("seq < 60").select(F.col("label").cast("string").alias("lane"), F.col("vector").alias("v"))
    return _by_prototypes(points.select("seq", "vector"), protos, 0.30, 0.08)


def _by_prototypes(facts: DataFrame, protos: DataFrame, least: float, margin: float, top: int = 3) -> DataFrame:
    """Lane of each fact by the mean of its ``top`` best exemplars; null lanes (too low, too close) are left out.

    Exemplars are a taxonomy of bounded size, packed into one row a lane.
    """
    lanes = protos.groupBy("lane").agg(F.collect_list("v").alias("vs"))
    scored = facts.crossJoin(F.broadcast(lanes)).select(
        "seq", "lane", F.slice(F.reverse(F.array_sort(F.transform("vs", lambda v: R.cosine(F.col("vector"), v)))), 1, top).alias("best")
    )
    scored = scored.select("seq", F.struct((-F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")).alias("s"), "lane").alias("x"))
    both = scored.groupBy("seq").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 2).alias("xs"))
    first, second = F.col("xs")[0], F.get("xs", F.lit(1))
    return both.where((-first["s"] >= least) & (second.isNull() | (second["s"] - first["s"] >= margin))).select("seq", first["lane"].alias("lane"))


@query(
    "f24_fact_ids", "points",
    "SELECT id, md5(data) AS hash, concat('session-2024-01-01-', substr(sha256(concat_ws('|', coalesce(project, ''), id, hash)), 1, 8)) AS summary_id, "
    "concat_ws('-', h[1:8], h[9:12], concat('5', h[14:16]), concat(substr('89ab89ab89ab89ab', 1 + instr('0123456789abcdef', h[17:17]) - 1, 1), h[18:20]), h[21:32]) AS fact_id FROM "
    "(SELECT *, sha1(from_hex('e2de504c45bb4531952ff33a6f60c945') || encode(concat(md5(data), ':', user_id, CASE WHEN lane IS NULL AND persona IS NULL THEN '' ELSE concat(':', coalesce(lane, ''), ':', coalesce(persona, '')) END))) AS h FROM points)",
)
def _(points):
    return points.select("id", T.content_hash(F.col("data")).alias("hash"), T.summary_id(F.coalesce("project", F.lit("")), F.lit("2024-01-01"), F.col("id"), F.col("hash")).alias("summary_id"), T.fact_id(*map(F.col, ("data", "user_id", "lane", "persona"))).alias("fact_id"))


@query(
    "f28_calibration_band", "points",
    "SELECT CASE WHEN score > 0.95 THEN 'dedup-risk' WHEN score >= 0.84 THEN 'inband' WHEN score >= 0.45 THEN 'detector' ELSE 'no-fire' END AS band, CAST(count(*) AS BIGINT) AS n FROM points GROUP BY 1",
)
def _(points):
    band = F.when(F.col("score") > 0.95, "dedup-risk").when(F.col("score") >= 0.84, "inband").when(F.col("score") >= 0.45, "detector").otherwise("no-fire")
    return points.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    "f41_tokens", "",
    "SELECT doc_id, CAST(len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 30)) AS INT) AS n FROM documents",
)
def _(spark, sf_dir):
    return raw(spark, sf_dir, "documents").select("doc_id", F.size(V.tokens(F.col("text"))).alias("n"))


@query(
    "f13_iso_weeks", "signals",
    "SELECT strftime(day, '%G-W%V') AS week, CAST(count(*) AS BIGINT) AS n FROM signals GROUP BY 1",
)
def _(signals):
    week = F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), "day"), F.weekofyear("day"))
    return signals.groupBy(week.alias("week")).agg(F.count("*").alias("n"))


# ---- Retrieval, graph, evaluation -------------------------------------------

_TOK = "SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 30) AS t FROM documents"


@query(
    "g03_bm25", "",
    f"WITH d AS ({_TOK}), c AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d), tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN ('thea', 'wher', 'ondea', 'anin') GROUP BY doc_id, t, term), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (term), c GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10",
)
def _(spark, sf_dir):
    return V.bm25(raw(spark, sf_dir, "documents"), ["thea", "wher", "ondea", "anin", "thea"], 10)


@query("g04_match_all", "", f"SELECT doc_id FROM ({_TOK}) WHERE list_has_all(t, ['the', 'and', 'of'])")
def _(spark, sf_dir):
    return V.match_all(raw(spark, sf_dir, "documents"), ["the", "and", "of"])


@query(
    "g05_rank_fusion", "points",
    "SELECT doc_id, round(sum(s), 9) AS score FROM (SELECT seq AS doc_id, 1.0 / (60 + rank) AS s FROM (SELECT seq, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM points WHERE score IS NOT NULL) "
    "UNION ALL SELECT seq, 0.5 / (60 + rank) FROM (SELECT seq, row_number() OVER (ORDER BY valid_from DESC, seq) AS rank FROM points WHERE valid_from IS NOT NULL)) GROUP BY doc_id",
)
def _(points):
    def arm(rows: DataFrame, *order) -> DataFrame:
        return V.global_rank(rows.select(F.col("seq").alias("doc_id"), "score", "valid_from", "seq"), *order)

    a = arm(points.where("score IS NOT NULL"), F.col("score").desc(), F.col("seq"))
    b = arm(points.where("valid_from IS NOT NULL"), F.col("valid_from").desc(), F.col("seq"))
    return V.fuse([(a, 1.0), (b, 0.5), (b, 0.0)])


_EDGE = (
    "(SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT l.note AS src, m.note AS dst FROM (SELECT note, a AS target FROM notes UNION ALL SELECT note, b FROM notes WHERE b IS NOT NULL) l "
    "JOIN (SELECT lower(alias) AS name, min_by(note, k) AS note FROM notes GROUP BY 1) m ON m.name = lower(l.target)) WHERE src <> dst)"
)


@query(
    "g06_components", "notes",
    f"SELECT * FROM (WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGE} UNION SELECT dst, src FROM {_EDGE}), w(note, place) AS (SELECT note, note FROM notes UNION SELECT w.note, e.dst FROM w JOIN e ON e.src = w.place), "
    "c AS (SELECT note, min(place) AS component FROM w GROUP BY note) SELECT note, component, CAST(count(*) OVER (PARTITION BY component) AS BIGINT) AS size FROM c)",
)
def _(notes):
    return G.components(notes.select("note"), G.undirected(_edges(notes))).select("note", "component", "size")


@query(
    "g07_interlinks", "notes",
    f"SELECT * FROM (WITH e AS (SELECT src, dst FROM {_EDGE}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT x.src AS note, CAST(count(DISTINCT x.dst) AS BIGINT) AS ring, "
    "CAST(count(e.src) AS BIGINT) AS interlinks FROM b x JOIN b y ON x.src = y.src LEFT JOIN e ON e.src = x.dst AND e.dst = y.dst GROUP BY 1)",
)
def _(notes):
    return G.interlinks(_edges(notes))


@query(
    "a21_degrees", "notes",
    f"SELECT n.note, CAST(coalesce(i.c, 0) AS BIGINT) AS n_in, CAST(coalesce(o.c, 0) AS BIGINT) AS n_out, CAST(coalesce(i.c, 0) + coalesce(o.c, 0) AS BIGINT) AS degree, coalesce(i.c, 0) + coalesce(o.c, 0) = 0 AS orphan "
    f"FROM notes n LEFT JOIN (SELECT dst, count(*) AS c FROM {_EDGE} GROUP BY 1) i ON i.dst = n.note LEFT JOIN (SELECT src, count(*) AS c FROM {_EDGE} GROUP BY 1) o ON o.src = n.note",
)
def _(notes):
    return G.degrees(notes.select("note"), G.undirected(_edges(notes)))


@query(
    "g08_dangling", "notes",
    "SELECT l.note AS src, l.target FROM (SELECT note, a AS target FROM notes UNION ALL SELECT note, b FROM notes WHERE b IS NOT NULL) l WHERE lower(l.target) NOT IN (SELECT lower(alias) FROM notes)",
)
def _(notes):
    links = notes.select(F.col("note").alias("src"), F.col("a").alias("target")).union(notes.where("b IS NOT NULL").select("note", "b"))
    return G.resolve_links(links, notes.select("alias", "note", F.col("k").alias("order")))[1]


_RANKED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k) AS rank FROM judged"


@query(
    "e02_retrieval_metrics", "judged",
    f"SELECT qid, CAST(max(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) AS INT) AS hit, round(coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0.0), 6) AS rr, "
    "round(CASE WHEN count(*) FILTER (relevant) > 0 THEN sum(CASE WHEN relevant AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0.0 END) / list_sum(list_transform(generate_series(1, least(count(*) FILTER (relevant), 5)), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg "
    f"FROM ({_RANKED}) GROUP BY qid",
)
def _(judged):
    return V.metrics(judged)


@query(
    "e04_recall_by_level", "judged",
    f"SELECT level, round(avg(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM ({_RANKED}) GROUP BY level",
)
def _(judged):
    r = V.ranked(judged)
    return r.groupBy("level").agg(F.round(F.avg((F.col("relevant") & (F.col("rank") <= 5)).cast("double")), 6).alias("share"))


@query(
    "e13_wilson", "judged",
    "SELECT level, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi "
    "FROM (SELECT level, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (relevant) / CAST(count(*) AS DOUBLE) AS p FROM judged GROUP BY level)",
)
def _(judged):
    s = judged.groupBy("level").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("relevant").cast("double")).alias("h"))
    lo, hi = V.wilson(F.col("h"), F.col("n"))
    return s.select("level", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(
    "e15_threshold_sweep", "judged",
    "SELECT s / 20.0::DOUBLE AS threshold, round(tp / \"all\", 6) AS recall, round(tp / (tp + fp), 6) AS precision, CAST(5 * fp + \"all\" - tp AS BIGINT) AS cost FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS \"all\" "
    "FROM (SELECT CAST(floor(least(score, 0.999999) * 20) AS INT) AS s, CAST(count(*) FILTER (relevant) AS DOUBLE) AS pos, CAST(count(*) FILTER (NOT relevant) AS DOUBLE) AS neg FROM judged GROUP BY 1))",
)
def _(judged):
    return V.threshold_sweep(judged)


@query(
    "e17_lane_precision", "judged",
    "SELECT expected AS lane, round(count(*) FILTER (predicted = expected) / CAST(count(*) AS DOUBLE), 6) AS recall FROM judged WHERE expected IS NOT NULL GROUP BY 1",
)
def _(judged):
    j = judged.where("expected IS NOT NULL")
    return j.groupBy(F.col("expected").alias("lane")).agg(F.round(F.avg(F.coalesce((F.col("predicted") == F.col("expected")).cast("double"), F.lit(0.0))), 6).alias("recall"))


@query(
    "e28_cost_distribution", "judged",
    "SELECT level, round(quantile_cont(cost, 0.05), 4) AS p5, round(quantile_cont(cost, 0.5), 4) AS median, round(quantile_cont(cost, 0.95), 4) AS p95 FROM judged GROUP BY level",
)
def _(judged):
    p = F.percentile("cost", [0.05, 0.5, 0.95])
    return judged.groupBy("level").agg(p.alias("p")).select("level", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p5", "median", "p95"))))


# ---- Lifecycle --------------------------------------------------------------


@query(
    "m04_merge_older", "points",
    "SELECT m.*, coalesce(p.projects, '') AS projects FROM (SELECT user_id, hash, lane, persona, min(seq) AS seq, min_by(data, seq) AS data, CAST(count(*) AS BIGINT) AS dedup_count, max(seq) AS last_seen FROM points GROUP BY user_id, hash, lane, persona) m LEFT JOIN "
    "(SELECT user_id, hash, lane, persona, string_agg(project, ',' ORDER BY f) AS projects FROM (SELECT user_id, hash, lane, persona, project, min(seq) AS f FROM points WHERE project <> '' GROUP BY ALL) GROUP BY ALL) p "
    "ON p.user_id = m.user_id AND p.hash = m.hash AND p.lane IS NOT DISTINCT FROM m.lane AND p.persona IS NOT DISTINCT FROM m.persona",
)
def _(points):
    return A.merge_older(points)


@query(
    "m06_supersede", "points",
    "SELECT id, CASE WHEN seq % 17 = 0 AND status IS DISTINCT FROM 'superseded' THEN 'superseded' ELSE status END AS status, CASE WHEN seq % 17 = 0 AND status IS DISTINCT FROM 'superseded' THEN concat('p', CAST(seq + 1 AS STRING)) ELSE superseded_by END AS superseded_by FROM points",
)
def _(points):
    hit = (F.col("seq") % 17 == 0) & R.not_superseded()
    return points.select("id", F.when(hit, "superseded").otherwise(F.col("status")).alias("status"), F.when(hit, F.concat(F.lit("p"), (F.col("seq") + 1).cast("string"))).otherwise(F.col("superseded_by")).alias("superseded_by"))


@query(
    "m11_forget", "points",
    "SELECT id, CASE WHEN lane = 'lane2' THEN 'deprecated' ELSE status END AS status, CASE WHEN lane = 'lane2' THEN coalesce(invalidated_at, '2024-02-01T00:00:00Z') ELSE invalidated_at END AS invalidated_at FROM points",
)
def _(points):
    hit = F.coalesce(F.col("lane") == "lane2", F.lit(False))
    return points.select("id", F.when(hit, "deprecated").otherwise(F.col("status")).alias("status"), F.when(hit, F.coalesce("invalidated_at", F.lit("2024-02-01T00:00:00Z"))).otherwise(F.col("invalidated_at")).alias("invalidated_at"))


@query("w04_last_n", "signals", "SELECT surface, event_id FROM (SELECT surface, event_id, row_number() OVER (PARTITION BY surface ORDER BY event_id DESC) AS r FROM signals) WHERE r <= 512")
def _(signals):
    r = F.row_number().over(Window.partitionBy("surface").orderBy(F.col("event_id").desc()))
    return signals.withColumn("r", r).where("r <= 512").select("surface", "event_id")


@query("w06_running_watermark", "captures", "SELECT user_id, seq, max(created_at) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS watermark FROM captures")
def _(captures):
    return running(captures, ["user_id"], ["seq"], F.col("created_at"), "max", "watermark").select("user_id", "seq", "watermark")


@query(
    "f51_transcripts", "turns",
    "SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn, role, text) AS transcript FROM turns GROUP BY conv_id",
)
def _(turns):
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("transcript"))
