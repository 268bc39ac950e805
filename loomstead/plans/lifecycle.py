"""The write path, reactions and upkeep as batch queries over the derived tables, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import attribution as A
from loomstead.operators import folds
from loomstead.operators import recall as R
from loomstead.operators import writes as W
from loomstead.operators.scan import running
from loomstead.plans.memory import query

# Expressions that both engines read alike: what callers send and what a judge says.
_CALL = "CASE seq % 5 WHEN 0 THEN 'deprecated' WHEN 1 THEN '' END AS asked_status, seq % 4 = 0 AS trusted, seq % 3 = 0 AS authoritative"
_JUDGED = "seq % 2 = 0 AS contradicts, CAST(seq % 10 AS DOUBLE) / 10 AS confidence"


def _with(points: DataFrame, columns: str) -> DataFrame:
    return points.selectExpr("*", *columns.split(", "))


# ---- Writing facts ----------------------------------------------------------


@query(
    "m02_dedup_eligible", "points",
    "SELECT id, doc_id IS DISTINCT FROM '_embedding_stamp' AND seq % 10 <> 3 AS eligible FROM points",
)
def _(points):
    return points.select("id", W.eligible(~R.not_system(), F.col("seq") % 10 == 3).alias("eligible"))


@query(
    "m03_threshold", "points",
    "SELECT id, coalesce(CASE WHEN seq % 3 = 0 THEN NULL ELSE score END, 0.84) AS threshold FROM points",
)
def _(points):
    """A caller's threshold if it is a number, else the default."""
    asked = F.when(F.col("seq") % 3 == 0, F.lit("none")).otherwise(F.col("score").cast("string"))
    return points.select("id", W.threshold(asked).alias("threshold"))


@query(
    "m09_payload", "points",
    f"SELECT id, md5(data) AS hash, CASE WHEN trusted AND asked_status <> '' THEN asked_status ELSE 'current' END AS status, CASE WHEN valid_from IS NULL AND authoritative THEN '2024-02-01T00:00:00Z' ELSE valid_from END AS valid_from, "
    f"CASE WHEN project <> '' THEN project END AS projects, CAST(1 AS BIGINT) AS dedup_count FROM (SELECT *, {_CALL} FROM points)",
)
def _(points):
    built = W.payload(_with(points, _CALL), "2024-02-01T00:00:00Z")
    return built.select("id", "hash", "status", "valid_from", F.array_join("projects", ",").alias("projects"), "dedup_count")


@query("f27_in_band", "points", "SELECT id, coalesce(score BETWEEN 0.84 AND 0.95, FALSE) AS in_band FROM points")
def _(points):
    return points.select("id", W.in_band(F.col("score"), 0.84).alias("in_band"))


@query(
    "m05_inband_supersession", "points",
    f"SELECT id, coalesce((lane IS NOT NULL OR persona IS NOT NULL) AND score BETWEEN 0.3 AND 0.95 AND contradicts AND confidence >= 0.8, FALSE) AS supersede FROM (SELECT *, {_JUDGED} FROM points)",
)
def _(points):
    return _with(points, _JUDGED).select("id", W.supersedes(F.col("score"), F.col("contradicts"), F.col("confidence"), F.col("lane"), F.col("persona"), floor=0.3).alias("supersede"))


_ADD_SQL = (
    "SELECT seq, CASE WHEN dup IS NOT NULL THEN 'DEDUP_MERGED' WHEN near IS NOT NULL AND (lane IS NOT NULL OR persona IS NOT NULL) AND s BETWEEN 0.2 AND 0.6 AND seq % 2 = 0 AND seq % 30 >= 8 THEN 'SUPERSEDED_INBAND' WHEN near IS NOT NULL THEN 'DEDUP_MERGED' "
    "WHEN lead < seq THEN 'DEDUP_MERGED' ELSE 'ADD' END AS event, coalesce(dup, near, CASE WHEN lead < seq THEN lead END) AS target FROM (SELECT n.seq, n.lane, n.persona, d.dup, k.near, k.s, "
    "min(n.seq) OVER (PARTITION BY n.user_id, n.hash, n.lane, n.persona) AS lead FROM (SELECT * FROM points WHERE seq % 20 = 0 AND doc_id IS DISTINCT FROM '_embedding_stamp') n LEFT JOIN "
    "(SELECT user_id, hash, lane, persona, min(seq) AS dup FROM points WHERE seq % 20 <> 0 AND status IS DISTINCT FROM 'superseded' GROUP BY ALL) d ON d.user_id = n.user_id AND d.hash = n.hash AND d.lane IS NOT DISTINCT FROM n.lane AND d.persona IS NOT DISTINCT FROM n.persona "
    "LEFT JOIN (SELECT q, near, s FROM (SELECT q.seq AS q, p.seq AS near, list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) * list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) AS s, "
    "row_number() OVER (PARTITION BY q.seq ORDER BY list_dot_product(q.vector::DOUBLE[], p.vector::DOUBLE[]) / sqrt(list_dot_product(q.vector::DOUBLE[], q.vector::DOUBLE[]) * list_dot_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) DESC, p.seq) AS r FROM points q JOIN points p ON q.seq % 20 = 0 AND p.seq % 20 <> 0 "
    "AND p.status IS DISTINCT FROM 'superseded' AND q.user_id = p.user_id AND q.lane IS NOT DISTINCT FROM p.lane AND q.persona IS NOT DISTINCT FROM p.persona) WHERE r = 1 AND s >= 0.2) k ON k.q = n.seq)"
)


@query("m01_add_batch", "points", _ADD_SQL)
def _(points):
    """Facts whose id is divisible by 20 are written to a store of all others; a judge's verdict is a column of theirs."""
    judged = points.selectExpr("*", "seq % 2 = 0 AS contradicts", "CASE WHEN seq % 30 >= 8 THEN 0.9D ELSE 0.5D END AS confidence")
    facts = judged.where("seq % 20 = 0").where(R.not_system())
    return W.add_batch(facts, points.where("seq % 20 <> 0"), least=0.2, ceiling=0.6).select("seq", "event", "target")


@query(
    "m01_event_counts", "points", f"SELECT event, CAST(count(*) AS BIGINT) AS n FROM ({_ADD_SQL}) GROUP BY event",
)
def _(points):
    judged = points.selectExpr("*", "seq % 2 = 0 AS contradicts", "CASE WHEN seq % 30 >= 8 THEN 0.9D ELSE 0.5D END AS confidence")
    facts = judged.where("seq % 20 = 0").where(R.not_system())
    return W.add_batch(facts, points.where("seq % 20 <> 0"), least=0.2, ceiling=0.6).groupBy("event").agg(F.count("*").alias("n"))


def planted(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts to write and the store they meet: every point is written again in two near copies, one within the band and
    one above it, some with its text; points of even seq are stored before."""
    near = lambda by: F.transform("vector", lambda x, i: x.cast("double") + F.when(i % 2 == 0, by).otherwise(-by) * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")) / 64))
    judged = points.where(R.not_system()).selectExpr("seq", "user_id", "lane", "persona", "status", "hash", "vector", "seq % 3 <> 0 AS contradicts", "CASE WHEN seq % 10 >= 4 THEN 0.9D ELSE 0.5D END AS confidence")
    own = F.md5(F.col("seq").cast("string"))
    plain = judged.withColumn("vector", F.transform("vector", lambda x: x.cast("double"))).withColumn("hash", own)
    again = judged.withColumn("vector", near(0.45)).withColumn("seq", F.col("seq") * 2 + 1_000_000).withColumn("hash", F.when(F.col("seq") % 20 == 0, own).otherwise(F.md5(F.concat(own, F.lit("a")))))
    close = judged.withColumn("vector", near(0.1)).withColumn("seq", F.col("seq") * 2 + 1_000_001).withColumn("hash", F.md5(F.concat(own, F.lit("b"))))
    facts = plain.where("seq % 2 = 1").union(again).union(close)
    return facts.drop("status"), plain.where("seq % 2 = 0")


@query("m01_add_in_order", "points")
def _(points):
    """Facts written one after another, at the default threshold and band."""
    return folds.add_in_order(*planted(points))


_SAID = "CASE seq % 5 WHEN 0 THEN '{\"contradicts\": true, \"confidence\": 0.9}' WHEN 1 THEN concat('```json', chr(10), '{\"contradicts\": true, \"confidence\": 0.25}', chr(10), '```') WHEN 2 THEN 'no idea' WHEN 3 THEN '{\"contradicts\": false}' END AS said"


@query(
    "m08_judge_contract", "points",
    "SELECT id, seq % 5 IN (0, 1) AS contradicts, CASE seq % 5 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM points",
)
def _(points):
    """Whatever a judge says that can't be read is no contradiction, with confidence 0."""
    return points.selectExpr("id", _SAID).select("id", T.verdict(F.col("said")).alias("v")).select("id", "v.contradicts", "v.confidence")


@query(
    "m10_vault_supersede", "points",
    "SELECT id, CASE WHEN seq % 25 = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN seq % 25 = 0 THEN '2024-02-02' ELSE invalidated_at END AS invalidated_at, CASE WHEN seq % 25 = 0 THEN concat(id, '-v2') ELSE superseded_by END AS superseded_by FROM points "
    "UNION ALL SELECT concat(id, '-v2'), 'current', NULL, NULL FROM points WHERE seq % 25 = 0",
)
def _(points):
    docs = points.select("id", "status", "invalidated_at", "superseded_by")
    newer = points.where("seq % 25 = 0").select(F.concat("id", F.lit("-v2")).alias("id"), F.col("id").alias("replaces"))
    return W.supersede_documents(docs, newer, "2024-02-02")


@query(
    "m12_capture_authored", "points",
    "SELECT doc_id, coalesce(valid_from, '2024-02-03') AS valid_from, 'current' AS status FROM points WHERE doc_id IS NOT NULL AND coalesce(title, '') <> '' AND doc_id <> '_embedding_stamp'",
)
def _(points):
    ok = F.col("doc_id").isNotNull() & (F.coalesce("title", F.lit("")) != "") & R.not_system()
    return points.where(ok).select("doc_id", F.coalesce("valid_from", F.lit("2024-02-03")).alias("valid_from"), F.lit("current").alias("status"))


@query(
    "m13_reindex", "points",
    "SELECT coalesce(n.doc_id, p.doc_id) AS doc_id, coalesce(n.data, p.data) AS data FROM (SELECT doc_id, data FROM points WHERE doc_id IS NOT NULL AND seq % 8 = 4) p FULL JOIN (SELECT doc_id, concat(data, ' again') AS data FROM points WHERE doc_id IS NOT NULL AND title <> '' AND seq % 3 = 0) n ON n.doc_id = p.doc_id",
)
def _(points):
    """Documents with an id and a title replace what the index has under their id."""
    old = points.where("doc_id IS NOT NULL AND seq % 8 = 4").select("doc_id", "data")
    new = points.where("doc_id IS NOT NULL AND title <> '' AND seq % 3 = 0").select("doc_id", F.concat("data", F.lit(" again")).alias("data"))
    return old.join(new, "doc_id", "left_anti").unionByName(new)


@query(
    "m16_import_judge", "points",
    "SELECT id, CAST(seq // 25 AS BIGINT) AS batch, CASE WHEN seq % 7 IN (0, 1) THEN 'keep' WHEN seq % 7 IN (2, 3, 4, 5) THEN 'drop' ELSE 'unjudged' END AS decision FROM points",
)
def _(points):
    kinds = F.array(*map(F.lit, ("personal", "dev", "ephemeral", "stale_ops", "junk", "ops_domain", "other")))
    kind = F.get(kinds, (F.col("seq") % 7).cast("int"))
    return points.select("id", F.floor(F.col("seq") / W.JUDGE_BATCH).alias("batch"), W.import_decision(kind).alias("decision"))


@query(
    "m17_stamp_guard", "points",
    "SELECT id, len(vector) = 64 AND seq % 6 <> 2 AS fits FROM points",
)
def _(points):
    stamp = {"provider": "local", "model": "m1", "dimension": 64}
    model = F.when(F.col("seq") % 6 == 2, "m2").otherwise("m1")
    return points.select("id", W.stamp_fits(stamp, F.lit("local"), model, F.size("vector")).alias("fits"))


# ---- Ledger, bridge, swap ---------------------------------------------------


@query(
    "s14_ledger_append", "captures",
    "SELECT capture_id, concat('[{\"id\":\"', point_id, '\",\"event\":\"', CASE WHEN seq % 2 = 0 THEN 'ADD' ELSE 'DEDUP_MERGED' END, '\"}]') AS point_refs FROM captures WHERE run_id IS NOT NULL",
)
def _(captures):
    """A row for each capture that names a run; others are refused without failing the batch."""
    refs = F.array(F.struct(F.col("point_id").alias("id"), F.when(F.col("seq") % 2 == 0, "ADD").otherwise("DEDUP_MERGED").alias("event")))
    return captures.where("run_id IS NOT NULL").select("capture_id", F.to_json(refs).alias("point_refs"))


@query(
    "s18_bridge_translate", "points",
    "SELECT id, CASE WHEN project IS NULL OR project = '' THEN 'no project' END AS skipped, CASE WHEN project <> '' THEN concat('sessions/', project, '/bridge-', substr(sha256(id), 1, 16), '.md') END AS path, "
    "CASE WHEN project <> '' THEN substr(coalesce(nullif(title, ''), substr(data, 1, 80), concat('bridge-', substr(sha256(id), 1, 16))), 1, 200) END AS title FROM points",
)
def _(points):
    return W.translate(points.select(F.col("id").alias("session_id"), "project", "title", F.col("data").alias("summary")), "bridge").select(
        F.col("session_id").alias("id"), "skipped", "path", "title"
    )


@query(
    "s25_swap_verify", "points",
    "SELECT user_id, CAST(count(*) AS BIGINT) AS rows_, CAST(count(*) FILTER (seq % 50 <> 0) AS BIGINT) AS swapped, count(*) FILTER (doc_id = '_embedding_stamp') > 0 AS stamped, count(*) FILTER (seq % 50 <> 0) = count(*) AND count(*) FILTER (doc_id = '_embedding_stamp') > 0 AS ok FROM points GROUP BY user_id",
)
def _(points):
    """A rebuilt index is taken over where it has its stamp and as many rows as the old one."""
    s = points.groupBy("user_id").agg(F.count("*").alias("rows_"), F.count_if(F.col("seq") % 50 != 0).alias("swapped"), (F.count_if(~R.not_system()) > 0).alias("stamped"))
    return s.withColumn("ok", (F.col("rows_") == F.col("swapped")) & F.col("stamped"))


@query(
    "p12_compat_record", "points",
    "SELECT id, data AS memory, CASE WHEN lane IS NULL THEN concat('cat', CAST(seq % 3 AS STRING)) WHEN seq % 4 = 1 THEN lane ELSE concat(lane, ',cat', CAST(seq % 3 AS STRING)) END AS categories, user_id, valid_from AS created_at FROM points",
)
def _(points):
    stored = F.array(F.when((F.col("seq") % 4 == 1) & F.col("lane").isNotNull(), F.col("lane")).otherwise(F.concat(F.lit("cat"), (F.col("seq") % 3).cast("string"))))
    return points.select("id", F.col("data").alias("memory"), F.array_join(W.categories(F.col("lane"), stored), ",").alias("categories"), "user_id", F.col("valid_from").alias("created_at"))


# ---- Reactions --------------------------------------------------------------


@query(
    "p24_reaction_outcomes", "reactions",
    "SELECT message_id, CASE WHEN seq % 17 = 0 THEN 'invalid' WHEN n - 1 < 0 THEN 'invalid' WHEN ts > TIMESTAMP '2024-01-25 00:00:00' + INTERVAL 120 SECOND THEN 'unaddressed' ELSE 'valid' END AS outcome FROM reactions",
)
def _(reactions):
    run = F.when(F.col("seq") % 17 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("run_id"))
    return reactions.select("message_id", W.reaction_outcome(run, F.col("message_id"), F.col("ts"), F.col("n") - 1, F.lit("2024-01-25 00:00:00").cast("timestamp")).alias("outcome"))


@query(
    "j04_hash_override", "reactions captures",
    "SELECT r.message_id, coalesce(h.capture_id, b.capture_id) AS capture_id FROM reactions r LEFT JOIN (SELECT message_id, min(capture_id) AS capture_id FROM (SELECT r.message_id, c.capture_id FROM reactions r JOIN captures c ON c.user_id = r.user_id AND r.seq % 10 = c.seq % 10 AND r.seq % 97 = c.seq % 97) GROUP BY 1) h ON h.message_id = r.message_id "
    "LEFT JOIN (SELECT message_id, capture_id FROM (SELECT r.message_id, c.capture_id, row_number() OVER (PARTITION BY r.message_id ORDER BY (c.run_id IS NULL), (c.created_at < r.ts), abs(epoch_us(c.created_at) - epoch_us(r.ts)), c.capture_id) AS k FROM reactions r JOIN captures c ON c.user_id = r.user_id "
    "AND (c.run_id IS NULL OR c.run_id = r.run_id) AND c.created_at >= r.ts - INTERVAL 120 SECOND AND c.created_at <= r.ts + INTERVAL 24 HOUR) WHERE k = 1) b ON b.message_id = r.message_id",
)
def _(reactions, captures):
    """A capture that holds the message's hash comes before the nearest in time."""
    mark = lambda: F.concat_ws("-", F.col("seq") % 10, F.col("seq") % 97)
    hashed = captures.select("*", F.array(mark()).alias("hashes"))
    return A.override_by_hash(A.asof_reactions(reactions, captures), reactions.withColumn("hash", mark()), hashed)


_REFS = "concat('[{\"id\":\"p', CAST(seq % 10 AS STRING), '\",\"event\":\"ADD\"},{\"id\":\"q\",\"event\":\"ADD\"}]')"


@query(
    "f62_update_point_ref", "captures",
    "SELECT capture_id, CASE WHEN seq % 13 = 0 THEN 'broken' ELSE concat('[{\"id\":\"', CASE WHEN seq % 10 = 3 THEN 'p3-new' ELSE concat('p', CAST(seq % 10 AS STRING)) END, '\",\"event\":\"ADD\"},{\"id\":\"q\",\"event\":\"ADD\"}]') END AS point_refs FROM captures",
)
def _(captures):
    rows = captures.selectExpr("capture_id", f"CASE WHEN seq % 13 = 0 THEN 'broken' ELSE {_REFS} END AS point_refs")
    return rows.select("capture_id", W.update_ref(F.col("point_refs"), "p3", "p3-new").alias("point_refs"))


@query(
    "f60_json_columns", "captures",
    "SELECT capture_id, CASE WHEN seq % 13 = 0 THEN NULL ELSE CAST(2 AS INT) END AS n_refs, seq % 13 <> 0 AND seq % 10 = 3 AS holds FROM captures",
)
def _(captures):
    """Malformed lists have no members."""
    rows = captures.selectExpr("capture_id", f"CASE WHEN seq % 13 = 0 THEN 'broken' ELSE {_REFS} END AS point_refs")
    refs = W.refs(F.col("point_refs"))
    return rows.select("capture_id", F.when(refs.isNotNull(), F.size(refs)).alias("n_refs"), F.coalesce(F.array_contains(F.transform(refs, lambda r: r["id"]), "p3"), F.lit(False)).alias("holds"))


@query(
    "f64_reaction_types", "reactions",
    "SELECT message_id, CASE WHEN n >= 2 THEN concat(kind, ',thanks') WHEN n = 1 THEN kind ELSE '' END AS types FROM reactions",
)
def _(reactions):
    """Labels that at least one person gave, each once, in the order first seen."""
    given = F.array(*(F.struct(k.alias("kind"), c.cast("bigint").alias("count"), F.lit(own).alias("own")) for k, c, own in (
        (F.col("kind"), F.col("n"), False), (F.lit("own"), F.lit(1), True), (F.col("kind"), F.col("n"), False), (F.lit("thanks"), F.col("n") - 1, False))))
    return reactions.select("message_id", F.array_join(W.reaction_types(given), ",").alias("types"))


@query(
    "m15_reaction_state", "reactions captures",
    "SELECT capture_id, CAST(sum(n) AS BIGINT) AS total, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT c.capture_id, r.n, r.kind, row_number() OVER (PARTITION BY r.message_id ORDER BY (c.run_id IS NULL), (c.created_at < r.ts), abs(epoch_us(c.created_at) - epoch_us(r.ts)), c.capture_id) AS k FROM reactions r JOIN captures c ON c.user_id = r.user_id "
    "AND (c.run_id IS NULL OR c.run_id = r.run_id) AND c.created_at >= r.ts - INTERVAL 120 SECOND AND c.created_at <= r.ts + INTERVAL 24 HOUR) WHERE k = 1 GROUP BY capture_id",
)
def _(reactions, captures):
    """The state of each capture after a batch: the last count a message has, summed, and the kinds seen."""
    placed = A.asof_reactions(reactions, captures).where("capture_id IS NOT NULL")
    last = A.latest(reactions, "message_id", "seq").select("message_id", "n", "kind")
    met = placed.join(last, "message_id")
    return met.groupBy("capture_id").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# ---- Maps, paths, manifests -------------------------------------------------


@query(
    "f65_open_map_split", "points",
    "SELECT id, CAST((project IS NOT NULL)::INT + (title IS NOT NULL)::INT AS INT) AS open_keys, CAST((lane IS NOT NULL)::INT + (status IS NOT NULL)::INT AS INT) AS reserved_keys FROM points",
)
def _(points):
    all_ = F.map_filter(F.create_map(*(x for c in ("project", "title", "lane", "status") for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    reserved, rest = W.split_map(all_, ("lane", "status"))
    return points.select("id", F.size(rest).alias("open_keys"), F.size(reserved).alias("reserved_keys"))


@query("f66_path_get", "", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, props ->> '$.missing.deep' AS missing FROM events")
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.missing.deep").alias("missing"))


@query(
    "f67_manifest_lines", "points",
    "SELECT id, concat('{\"id\":\"', id, '\",\"text\":\"', data, '\",\"user_id\":\"', user_id, '\"', CASE WHEN lane IS NULL THEN '' ELSE concat(',\"lane\":\"', lane, '\"') END, '}') AS line FROM points",
)
def _(points):
    return points.select("id", F.to_json(F.struct("id", F.col("data").alias("text"), "user_id", "lane")).alias("line"))


# ---- Decisions --------------------------------------------------------------

_FRONT = (
    "concat('---', chr(10), 'id: ', lpad(CAST(k % 10000 AS STRING), 4, '0'), '-some-choice', chr(10), 'title: \"Choice ', CAST(k AS STRING), '\"', chr(10), 'status: ', CASE WHEN k % 4 = 0 THEN 'superseded' ELSE 'accepted' END, chr(10), 'supersedes: ', "
    "CASE k % 3 WHEN 0 THEN concat('[\"', lpad(CAST((k + 7) % 10000 AS STRING), 4, '0'), '-x\", ', lpad(CAST(k % 10000 AS STRING), 4, '0'), ']') WHEN 1 THEN concat(chr(10), '  - ', lpad(CAST((k + 3000) % 10000 AS STRING), 4, '0'), '-gone') ELSE '~' END, chr(10), 'superseded_by: ', "
    "CASE WHEN k % 5 = 0 THEN concat(lpad(CAST((k + 1) % 10000 AS STRING), 4, '0'), '-next') ELSE 'null' END, chr(10), '---', chr(10), 'Body') AS text"
)
_DECISIONS = "(SELECT lpad(CAST(k % 10000 AS STRING), 4, '0') AS key, k % 3 AS m, k FROM notes)"


@query(
    "f49_decision_front_matter", "notes",
    f"SELECT key, concat('Choice ', CAST(k AS STRING)) AS title, CASE WHEN k % 4 = 0 THEN 'superseded' ELSE 'accepted' END AS status, CASE m WHEN 0 THEN concat(lpad(CAST((k + 7) % 10000 AS STRING), 4, '0'), ',', key) WHEN 1 THEN lpad(CAST((k + 3000) % 10000 AS STRING), 4, '0') ELSE '' END AS supersedes, "
    f"CASE WHEN k % 5 = 0 THEN lpad(CAST((k + 1) % 10000 AS STRING), 4, '0') END AS superseded_by FROM {_DECISIONS}",
)
def _(notes):
    d = W.decisions(notes.selectExpr("note AS name", _FRONT))
    return d.select("key", "title", "status", F.array_join("supersedes", ",").alias("supersedes"), "superseded_by")


@query(
    "g09_decision_graph", "notes",
    f"SELECT DISTINCT src, dst, dst NOT IN (SELECT key FROM {_DECISIONS}) OR src NOT IN (SELECT key FROM {_DECISIONS}) AS dangling FROM (SELECT key AS src, lpad(CAST((k + 7) % 10000 AS STRING), 4, '0') AS dst FROM {_DECISIONS} WHERE m = 0 UNION ALL SELECT key, lpad(CAST((k + 3000) % 10000 AS STRING), 4, '0') FROM {_DECISIONS} WHERE m = 1 "
    f"UNION ALL SELECT lpad(CAST((k + 1) % 10000 AS STRING), 4, '0'), key FROM {_DECISIONS} WHERE k % 5 = 0) WHERE src <> dst",
)
def _(notes):
    return W.decision_graph(W.decisions(notes.selectExpr("note AS name", _FRONT)))


@query(
    "t11_link_ranking", "notes",
    "SELECT note, CAST(row_number() OVER (ORDER BY n_in DESC, n_in + n_out DESC, note) AS BIGINT) AS place FROM (SELECT n.note, coalesce(i.c, 0) AS n_in, coalesce(o.c, 0) AS n_out FROM notes n LEFT JOIN (SELECT a AS note, count(*) AS c FROM notes GROUP BY 1) i ON i.note = n.note LEFT JOIN (SELECT note, count(*) AS c FROM notes WHERE a IS NOT NULL GROUP BY 1) o ON o.note = n.note)",
)
def _(notes):
    from loomstead.operators.retrieval import global_rank

    n_in = notes.groupBy(F.col("a").alias("note")).agg(F.count("*").alias("n_in"))
    n_out = notes.where("a IS NOT NULL").groupBy("note").agg(F.count("*").alias("n_out"))
    both = notes.select("note").join(n_in, "note", "left").join(n_out, "note", "left").na.fill(0, ["n_in", "n_out"])
    return global_rank(both, F.col("n_in").desc(), (F.col("n_in") + F.col("n_out")).desc(), F.col("note")).select("note", F.col("rank").cast("bigint").alias("place"))


# ---- Turns, windows, limits -------------------------------------------------


@query(
    "w07_forward_fill", "turns",
    "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS carried FROM turns",
)
def _(turns):
    """Turns without a header of their own carry the time of the last one that has one."""
    headed = F.when(F.col("turn") % 3 == 0, F.col("turn"))
    return running(turns, ["conv_id"], ["turn", "role", "text"], headed, "last", "carried").select("conv_id", "turn", "carried")


@query(
    "st10_window_mode", "signals",
    "SELECT project, day, CAST(count(*) AS BIGINT) AS n FROM signals WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY ALL",
)
def _(signals):
    """A window of days read by itself; no offset is kept or moved."""
    return signals.where("day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'").groupBy("project", "day").agg(F.count("*").alias("n"))


@query(
    "st12_retention_fold", "captures attached",
    "SELECT CAST(created_at AS DATE) AS day, user_id, surface, verdict, CAST(count(*) AS BIGINT) AS n FROM captures WHERE created_at < TIMESTAMP '2024-01-20 00:00:00' AND capture_id NOT IN (SELECT capture_id FROM attached WHERE n > 0) GROUP BY ALL",
)
def _(captures, attached):
    """Captures past their time that nobody reacted to leave the ledger and are counted."""
    old = captures.where(F.col("created_at").cast("timestamp") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    kept = A.prunable(old, attached.where("n > 0"), attached.where("n > 0"))
    return kept.groupBy(F.to_date("created_at").alias("day"), "user_id", "surface", "verdict").agg(F.count("*").alias("n"))


@query("st13_token_bucket", "signals")
def _(signals):
    """Admission of every signal by its surface's token bucket; see ``writes.admitted``."""
    return W.admitted(signals.select("event_id", F.col("surface").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")), per_minute=1.0, burst=10)


@query(
    "t04_narrow_back", "points",
    "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, seq) AS r FROM points) JOIN "
    "(SELECT user_id, count(*) FILTER (valid_from BETWEEN CASE user_id WHEN 'u0' THEN '2030-01-01' ELSE '2024-03-01' END AND CASE user_id WHEN 'u0' THEN '2030-12-31' ELSE '2024-04-30' END) AS inside FROM points GROUP BY user_id) USING (user_id) "
    "WHERE r <= CASE WHEN inside = 0 THEN 5 ELSE 25 END",
)
def _(points):
    """A window in which nothing lies gives the plain number of hits, not the widened one: for one user it is empty, for the others not."""
    low, high = (F.when(F.col("user_id") == "u0", a).otherwise(b) for a, b in (("2030-01-01", "2024-03-01"), ("2030-12-31", "2024-04-30")))
    inside = points.groupBy("user_id").agg(F.count_if(F.col("valid_from").between(low, high)).alias("inside"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("score").desc_nulls_last(), "seq"))
    wide = points.select("user_id", "id", place.alias("r")).where("r <= 25")
    return wide.join(inside, "user_id").where("r <= CASE WHEN inside = 0 THEN 5 ELSE 25 END").select("user_id", "id")


@query(
    "g10_advisory_gate", "judged",
    "SELECT k, CASE WHEN score > 0.6 THEN TRUE WHEN k % 4 = 0 THEN NULL ELSE relevant END AS said, CASE WHEN score > 0.6 THEN TRUE ELSE coalesce(CASE WHEN k % 4 = 0 THEN NULL ELSE relevant END, TRUE) END AS answered, score <= 0.6 AS judged FROM judged",
)
def _(judged):
    """Confident hits skip the judge; a judge that fails counts as answered."""
    sure = F.col("score") > 0.6
    said = F.when(sure, F.lit(True)).when(F.col("k") % 4 != 0, F.col("relevant"))
    return judged.select("k", said.alias("said"), F.coalesce(said, F.lit(True)).alias("answered"), (~sure).alias("judged"))


# ---- Text -------------------------------------------------------------------


@query(
    "f40_plain_tokens", "",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(lower(concat(p_name, ' (', p_type, ')')), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '[()]', '', 'g')), lambda w: w <> ''), '|') AS words FROM part",
)
def _(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", F.array_join(F.transform(T.word_tokens(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))), lambda w: F.regexp_replace(w, "[()]", "")), "|").alias("words"))


@query(
    "f43_rare_token_leak", "",
    "WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\w.-]+@[\\w.-]+|\\d{3,}')) AS token FROM documents), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\w.-]+@[\\w.-]+|\\d{3,}')) AS token FROM documents WHERE source = 'web') "
    "SELECT doc_id, CAST(count(*) AS BIGINT) AS shared FROM d JOIN b USING (token) GROUP BY doc_id",
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rare = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(T.rare_tokens(F.col("text")))).alias("token")).distinct()
    return rare(docs, "doc_id").join(rare(docs.where("source = 'web'")), "token").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(
    "f47_capped_documents", "",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), chr(10), '...') ELSE text END AS text FROM documents",
)
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", T.capped(F.col("text"), 200).alias("text"))


@query(
    "f46_byte_budget", "",
    "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4096.0) AS BIGINT) AS least_parts FROM documents WHERE text IS NOT NULL",
)
def _(spark, sf_dir):
    """Texts cut into pieces of at most 4096 bytes at whole characters take as few pieces as their bytes allow or one more for each few; told is the least."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    pieces = docs.select("doc_id", "text", F.explode_outer(T.byte_pieces(F.col("text"), 4096)).alias("piece"))
    whole = pieces.groupBy("doc_id").agg(F.sum(F.octet_length("piece")).alias("bytes"), F.max(F.octet_length("piece")).alias("most"))
    return whole.where("coalesce(most, 0) <= 4096").select("doc_id", F.ceil(F.coalesce("bytes", F.lit(0)) / 4096).alias("least_parts"))


@query(
    "f29_storage_projection", "points",
    "SELECT user_id, CAST(count(*) * 64 * 4 + CASE WHEN count(*) >= 20000 THEN count(*) * 16 * 8 ELSE 0 END + sum(length(data)) AS BIGINT) AS bytes_ FROM points GROUP BY user_id",
)
def _(points):
    n = F.count("*")
    return points.groupBy("user_id").agg(W.projected_bytes(n, F.sum(F.length("data")), 64).alias("bytes_"))


@query(
    "f06_item_dates", "points",
    "SELECT id, CASE WHEN valid_from IS NULL THEN NULL ELSE epoch_ms(CAST(valid_from AS TIMESTAMP)) END AS at_ms, coalesce(valid_from BETWEEN '2024-03-01' AND '2024-06-30', FALSE) AS inside FROM points",
)
def _(points):
    """Event time comes from ``valid_from`` alone; unreadable values have none."""
    at = R.epoch_ms(F.col("valid_from"))
    return points.select("id", at.alias("at_ms"), R.in_window(at, 1709251200000, 1719791999999).alias("inside"))


@query("f09_falloff", "points", "SELECT id, least(30.0::DOUBLE, greatest(1.0::DOUBLE, (seq % 90) * 0.5::DOUBLE)) AS days FROM points")
def _(points):
    """Days over which hits outside a window fade: half its width, 1 to 30."""
    return points.select("id", R.falloff((F.col("seq") % 90) * 86_400_000).alias("days"))


@query(
    "f48_wiki_links", "notes",
    "SELECT note, CASE WHEN b IS NULL OR b = a THEN a ELSE concat(a, ',', b) END AS targets FROM notes",
)
def _(notes):
    body = F.concat(F.lit("See [["), F.col("a"), F.lit("|this]], [["), F.col("a"), F.lit("#part]] "), F.coalesce(F.concat(F.lit("and [[ "), F.col("b"), F.lit(" ]]")), F.lit("")))
    return notes.select("note", F.array_join(T.wiki_links(body), ",").alias("targets"))


@query(
    "f45_turn_headers", "turns",
    "SELECT conv_id, turn, concat('2024-01-', lpad(CAST(turn % 28 + 1 AS STRING), 2, '0'), 'T10:00:00Z') AS header FROM turns WHERE role IN ('user', 'assistant', 'system')",
)
def _(turns):
    head = F.concat(F.lit("## 2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z "), F.col("role"), F.lit("\n"), F.col("text"))
    return turns.select("conv_id", "turn", F.get(T.turn_headers(head), F.lit(0)).alias("header")).where("header IS NOT NULL")


@query(
    "p25_title_slugs", "",
    "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM part",
)
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.title_slug(F.col("p_name")).alias("slug"))


@query(
    "f63_absolute_count", "reactions",
    "SELECT message_id, CAST(greatest(n - 1, 0) + n AS BIGINT) AS total FROM reactions",
)
def _(reactions):
    """People's reactions without the own one, over all labels."""
    lists = F.array(F.struct(F.col("n").alias("count"), F.lit(True).alias("me"), F.col("kind")), F.struct(F.col("n").alias("count"), F.lit(False).alias("me"), F.lit("x").alias("kind")))
    return reactions.select("message_id", T.reaction_total(lists).alias("total"))
