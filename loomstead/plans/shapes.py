"""Functions of text and time, and the whole path of a reaction, as queries with SQL to check them."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from loomstead.functions import temporal
from loomstead.functions import text as T
from loomstead.operators import attribution as A
from loomstead.plans.memory import query
from loomstead.session import shared_dir
from loomstead.sources import vault
from loomstead.sources.versions import Index, lookup

_PHRASE = (
    "CASE k % 17 WHEN 0 THEN 'on 2024-02-31 or yesterday' WHEN 1 THEN concat('what was on ', CAST(day AS STRING)) WHEN 2 THEN concat('all since ', CAST(day AS STRING)) WHEN 3 THEN 'trips in March' "
    "WHEN 4 THEN 'the last 3 days' WHEN 5 THEN 'past 2 weeks' WHEN 6 THEN 'last 1 month' WHEN 7 THEN 'Yesterday, please' WHEN 8 THEN 'today' WHEN 9 THEN 'last week' WHEN 10 THEN 'this week' "
    "WHEN 11 THEN 'last month' WHEN 12 THEN 'this month' WHEN 13 THEN 'last year' WHEN 14 THEN 'this year' WHEN 15 THEN 'they said \"yesterday\"' ELSE 'during may 2020' END"
)
_DAY_END = "CAST(epoch_ms({} + INTERVAL 1 DAY) - 1 AS BIGINT)"


def _spans() -> str:
    day = lambda d: f"CAST(epoch_ms({d}) AS BIGINT)"
    now, t = "CAST(epoch_ms(day + INTERVAL 750 MINUTE) AS BIGINT)", "CAST(day AS TIMESTAMP)"
    month = "make_date(year(day) - CASE WHEN month(day) < 3 THEN 1 ELSE 0 END, 3, 1)"
    back = "epoch_ms(day + INTERVAL 750 MINUTE - INTERVAL 1 MONTH)"
    of = {
        1: ("on_date", day(t), _DAY_END.format(t)), 2: ("since_date", day(t), now), 3: ("in_month", day(f"CAST({month} AS TIMESTAMP)"), f"CAST(epoch_ms({month} + INTERVAL 1 MONTH) - 1 AS BIGINT)"),
        4: ("last_n", f"{now} - 3 * 86400000", now), 5: ("last_n", f"{now} - 14 * 86400000", now), 6: ("last_n", f"CAST({back} AS BIGINT)", now),
        7: ("yesterday", day(f"{t} - INTERVAL 1 DAY"), _DAY_END.format(f"({t} - INTERVAL 1 DAY)")), 8: ("today", day(t), now),
        9: ("last_week", day(f"date_trunc('week', {t}) - INTERVAL 7 DAY"), _DAY_END.format(f"(date_trunc('week', {t}) - INTERVAL 1 DAY)")), 10: ("this_week", day(f"date_trunc('week', {t})"), now),
        11: ("last_month", day(f"date_trunc('month', {t}) - INTERVAL 1 MONTH"), _DAY_END.format(f"(date_trunc('month', {t}) - INTERVAL 1 DAY)")), 12: ("this_month", day(f"date_trunc('month', {t})"), now),
        13: ("last_year", day(f"date_trunc('year', {t}) - INTERVAL 1 YEAR"), _DAY_END.format(f"(date_trunc('year', {t}) - INTERVAL 1 DAY)")), 14: ("this_year", day(f"date_trunc('year', {t})"), now),
        16: ("in_month", day("TIMESTAMP '2020-05-01'"), "CAST(epoch_ms(TIMESTAMP '2020-06-01') - 1 AS BIGINT)"),
    }
    pick = lambda i: "CASE k % 17 " + " ".join(f"WHEN {k} THEN {v[i] if i else repr(v[i])}" for k, v in of.items()) + " END"
    return f"SELECT k, {pick(0)} AS kind, {pick(1)} AS start_ms, {pick(2)} AS end_ms, CASE WHEN k % 17 IN (0, 15) THEN NULL ELSE k % 17 IN (2, 4, 5, 6, 8, 10, 12, 14) END AS now_anchored FROM judged"


@query("f01_windows", "judged", _spans())
def _(judged):
    """The window in the words of a query, each asked at half past twelve of its day."""
    asked = judged.selectExpr("k", f"{_PHRASE} AS query", "CAST(day AS TIMESTAMP) + INTERVAL 750 MINUTES AS now")
    return asked.select("k", temporal.windows(F.col("query"), F.col("now")).alias("w")).select("k", "w.*")


@query(
    "p22_surfaces", "signals",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(nullif(substr(trim(lower(CASE WHEN event_id % 2 = 0 THEN concat('  ', upper(surface), ' ') ELSE '  ' END)), 1, 64), ''), 'unknown') WHEN event_id % 3 = 1 THEN concat(surface, repeat('x', 56)) ELSE surface END AS surface FROM signals",
)
def _(signals):
    """The first header that is not blank, in lower case, trimmed and cut to 64 characters."""
    own = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), F.upper("surface"), F.lit(" "))).otherwise("  "))
    other = F.when(F.col("event_id") % 3 == 1, F.concat(F.upper("surface"), F.repeat(F.lit("X"), 90))).when(F.col("event_id") % 3 == 2, F.col("surface"))
    return signals.select("event_id", T.surface(own, other).alias("surface"))


@query("f14_snowflakes", "signals", "SELECT event_id, CAST(((event_id + 175928847299117063) >> 22) + 1420070400000 AS BIGINT) AS ms FROM signals")
def _(signals):
    return signals.select("event_id", F.unix_millis(T.snowflake_time(F.col("event_id") + F.lit(175928847299117063))).alias("ms"))


_PICK = (
    "SELECT message_id, capture_id FROM (SELECT r.message_id, c.capture_id, row_number() OVER (PARTITION BY r.message_id ORDER BY (c.run_id IS NULL), (c.created_at < r.ts), abs(epoch_us(c.created_at) - epoch_us(r.ts)), c.capture_id) AS k "
    "FROM reactions r JOIN captures c ON c.user_id = r.user_id AND (c.run_id IS NULL OR c.run_id = r.run_id) AND c.created_at >= r.ts - INTERVAL 120 SECOND AND c.created_at <= r.ts + INTERVAL 24 HOUR) WHERE k = 1"
)


@query(
    "m15_attach", "reactions captures points",
    f"SELECT * FROM (WITH RECURSIVE picked AS ({_PICK}), state AS (SELECT p.capture_id, r.message_id, r.n, r.kind, row_number() OVER (PARTITION BY p.capture_id ORDER BY r.seq) AS place FROM reactions r JOIN picked p USING (message_id)), "
    "walk(id, place, status, nxt, hops) AS (SELECT id, id, status, superseded_by, 0 FROM points UNION ALL SELECT w.id, p.id, p.status, p.superseded_by, w.hops + 1 FROM walk w JOIN points p ON p.id = w.nxt WHERE w.status = 'superseded' AND w.hops < 8), "
    "ends AS (SELECT id, max(CASE WHEN status IS DISTINCT FROM 'superseded' THEN place END) AS terminal FROM walk GROUP BY id), "
    "held AS (SELECT DISTINCT e.terminal, c.capture_id, min(c.seq) OVER (PARTITION BY e.terminal, c.capture_id) AS first FROM captures c JOIN ends e ON e.id = c.point_id WHERE e.terminal IS NOT NULL), "
    "met AS (SELECT h.terminal, h.first, s.message_id, s.n, s.kind FROM held h JOIN state s USING (capture_id) WHERE s.place <= 64), "
    "kinds AS (SELECT terminal, kind, min((first, message_id)) AS spot FROM met GROUP BY ALL) "
    "SELECT t.terminal AS id, CAST(least(t.total, 1000) AS BIGINT) AS reaction_count, k.kinds AS reaction_types FROM (SELECT terminal, sum(n) AS total FROM met GROUP BY 1) t JOIN (SELECT terminal, string_agg(kind, ',' ORDER BY spot) AS kinds FROM kinds GROUP BY 1) k USING (terminal) WHERE t.total >= 1)",
)
def _(reactions, captures, points):
    """Reactions find their captures, their state is kept, and the points that stand for the captures' points are annotated."""
    placed = A.asof_reactions(reactions, captures).where("capture_id IS NOT NULL").join(reactions.select("message_id", "seq", "n", "kind"), "message_id")
    state, _ = A.reaction_state(placed)
    told = A.annotate_points(state, captures.select("capture_id", "point_id", "seq"), points)
    return told.select("id", "reaction_count", F.array_join("reaction_types", ",").alias("reaction_types"))


def _shapes() -> str:
    bare = "list_transform(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda w: regexp_replace(w, $e$" + T.EDGES + "$e$, '', 'g'))"
    hits = " OR ".join(f"(regexp_matches(w, $p${p}$p$) AND length(w) >= {dict([(3, 4), (5, 12)]).get(i, 1)})" for i, p in enumerate(T.ENTITY_SHAPES))
    return f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, md5(list_aggregate(list_sort(tokens), 'string_agg', ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_concat(list_filter({bare}, lambda w: {hits}), regexp_extract_all(text, '\\d{{3,}}'))) AS tokens FROM documents WHERE text IS NOT NULL) WHERE len(tokens) > 0"


@query("f43_entity_tokens", "", _shapes())
def _(spark, sf_dir):
    """Entity-shaped words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", T.entity_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    # Both engines order by bytes.
    return found.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("digest"))


@query(
    "s31_indexed_lookup", "points",
    "SELECT seq, lane, persona, hash FROM points WHERE hash IN (md5('fact 7'), md5('fact 91'), md5('none'))",
)
def _(points):
    """Points by their hash, from an index sorted by lane and persona with Bloom filters on hashes."""
    index = Index(points.sparkSession, shared_dir(points.sparkSession))
    rows = points.select("seq", "lane", "persona", "hash")
    index.swap(index.stage(rows, by=("lane", "persona"), looked_up=("hash",)), {"provider": "local", "model": "m1", "dimension": 64}, rows.count(), 0)
    return lookup(index.read(), [hashlib.md5(f.encode()).hexdigest() for f in ("fact 7", "fact 91", "none")])


# ---- Vaults: tables written out as files and read again ----------------------


def _suppliers(spark, sf_dir, *folders: str):
    """Suppliers as documents of a vault, the later folders with every fifth of them."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    front = F.create_map(F.lit("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("title"), F.col("s_name"))
    docs = s.select("s_suppkey", vault.render(front, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit("\n"))).alias("text"))
    root = shared_dir(spark)
    for i, folder in enumerate(folders):
        some = docs.where(F.col("s_suppkey") % 5 == 0) if i else docs
        vault.write_vault(some.select(F.concat(F.lit(f"{folder}/n"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), "text"), root)
    return vault.read_vault(spark, root)


@query(
    "s08_vault_round_trip", "",
    "SELECT concat('s', s_suppkey) AS doc_id, concat('s', s_suppkey) AS id, s_name AS title, 'native' AS source, concat('Nation ', s_nationkey, chr(10)) AS body, "
    "CAST(octet_length(encode(concat('---', chr(10), 'id: s', s_suppkey, chr(10), 'source: native', chr(10), 'title: ', s_name, chr(10), '---', chr(10), 'Nation ', s_nationkey, chr(10)))) AS BIGINT) AS size FROM supplier",
)
def _(spark, sf_dir):
    """Documents with front matter, written to files and read back."""
    front = lambda k: F.col("front_matter")[k].alias(k)
    return _suppliers(spark, sf_dir, "authored").select("doc_id", front("id"), front("title"), front("source"), "body", "size")


@query(
    "s11_find_by_id", "",
    "SELECT concat('s', s_suppkey) AS doc_id, concat(CASE WHEN s_suppkey % 5 = 0 THEN 'archive' ELSE 'authored' END, '/n', s_suppkey % 3, '/s', s_suppkey, '.md') AS path, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS copies FROM supplier",
)
def _(spark, sf_dir):
    """The file of each id; of several the one whose path is least, and how many there are."""
    found = _suppliers(spark, sf_dir, "authored", "archive").groupBy("doc_id").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    return found.select("doc_id", F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("path"), "copies")


@query(
    "s19_external_wrapper", "",
    "SELECT doc_id, md5(concat('<external-summary source=\"', source, '\">', chr(10), text, chr(10), '</external-summary>')) AS digest FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)) AND NOT regexp_matches(text, '(?i)</?external-summary')",
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fit = F.col("text").isNotNull() & ~F.col("text").contains("\x00") & ~F.col("text").rlike(vault.EXTERNAL_TAG)
    return docs.where(fit).select("doc_id", F.md5(vault.wrap_external(F.col("source"), F.col("text"))).alias("digest"))


@query(
    "s21_dump", "",
    "SELECT concat('s', s_suppkey) AS id, s_name AS text FROM supplier",
)
def _(spark, sf_dir):
    """JSON lines whose rows name their fields in either of two ways."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, odd = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("s_suppkey") % 2 == 1
    root = shared_dir(spark)
    s.select(F.when(odd, key).alias("mem0_id"), F.when(~odd, key).alias("id"), F.when(odd, F.col("s_name")).alias("text"), F.when(~odd, F.col("s_name")).alias("memory")).write.json(root)
    return vault.read_dump(spark, root)
