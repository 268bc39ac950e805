"""The write path: eligibility, payloads, supersession, batches of facts; reactions, decisions and admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators.recall import nearest, not_superseded

# The thresholds and categories that stored memories were written with.
DEDUP_THRESHOLD, BAND_CEILING, JUDGE_CONFIDENCE = 0.84, 0.95, 0.80
KEEP, DROP = ("personal", "dev"), ("ephemeral", "stale_ops", "junk", "ops_domain")
JUDGE_BATCH = 25
SKEW_S = 120

_REF = "array<struct<id:string,event:string>>"


def eligible(system: Column, migration: Column, enabled: bool = True) -> Column:
    """Whether a fact is looked up for duplicates: neither a system document nor part of a migration."""
    return F.lit(enabled) & ~F.coalesce(system, F.lit(False)) & ~F.coalesce(migration, F.lit(False))


def threshold(asked: Column, default: float = DEDUP_THRESHOLD) -> Column:
    return F.coalesce(asked.try_cast("double"), F.lit(default))


def payload(facts: DataFrame, now: str) -> DataFrame:
    """Stored fields of new facts: a trusted caller's status stands, others start as current; an event time is set
    where there is none and the caller is authoritative; the project also starts a set."""
    stated = F.col("trusted") & (F.coalesce("asked_status", F.lit("")) != "")
    undated = F.to_timestamp("valid_from").isNull()
    return facts.select(
        "id", F.md5("data").alias("hash"), F.when(stated, F.col("asked_status")).otherwise("current").alias("status"),
        F.when(undated & F.col("authoritative"), F.lit(now)).otherwise(F.col("valid_from")).alias("valid_from"),
        F.when(F.coalesce("project", F.lit("")) != "", F.array("project")).alias("projects"), F.lit(1).cast("bigint").alias("dedup_count"),
    )


def in_band(score: Column, floor: float, ceiling: float = BAND_CEILING) -> Column:
    return F.coalesce(score.between(floor, ceiling), F.lit(False))


def supersedes(
    score: Column, contradicts: Column, confidence: Column, lane: Column, persona: Column, *, floor: float, ceiling: float = BAND_CEILING, enabled: bool = True
) -> Column:
    """Whether a newer fact replaces its nearest older one: both in one lane or persona, alike but not the same, and a
    judge is sure that they contradict."""
    parted = (F.coalesce(lane, F.lit("")) != "") | (F.coalesce(persona, F.lit("")) != "")
    return F.lit(enabled) & parted & in_band(score, floor, ceiling) & F.coalesce(contradicts & (confidence >= JUDGE_CONFIDENCE), F.lit(False))


def add_batch(facts: DataFrame, store: DataFrame, *, least: float = DEDUP_THRESHOLD, ceiling: float = BAND_CEILING) -> DataFrame:
    """``facts`` with ``event`` and ``target``, written to ``store`` as one batch.

    In this order: an exact duplicate in the store takes the fact in; else the nearest stored fact of its user, lane and
    persona, if it is at least ``least`` alike, is superseded or takes it in; else the fact with the least ``seq`` among
    equal ones of the batch is added, and takes in the others.  Facts of one batch are not compared by similarity.
    """
    keys = ("user_id", "hash", "lane", "persona")
    current = store.where(not_superseded())
    same = lambda a, b: F.col(f"{a}.user_id").eqNullSafe(F.col(f"{b}.user_id")) & F.col(f"{a}.hash").eqNullSafe(F.col(f"{b}.hash")) & F.col(f"{a}.lane").eqNullSafe(F.col(f"{b}.lane")) & F.col(f"{a}.persona").eqNullSafe(F.col(f"{b}.persona"))
    held = current.groupBy(*keys).agg(F.min("seq").alias("dup"))
    first = facts.groupBy(*keys).agg(F.min("seq").alias("lead"))
    near = nearest(current, facts, 1, arms=("user_id", "lane", "persona"), least=least).select("query", F.col("seq").alias("near"), "score")
    f = facts.alias("f").join(held.alias("h"), same("f", "h"), "left").join(first.alias("l"), same("f", "l"), "left").select("f.*", "h.dup", "l.lead")
    f = f.drop("score").join(near, F.col("seq") == F.col("query"), "left")
    replaces = supersedes(F.col("score"), F.col("contradicts"), F.col("confidence"), F.col("lane"), F.col("persona"), floor=least, ceiling=ceiling)
    inside = F.when(F.col("lead") < F.col("seq"), F.col("lead"))
    event = F.when(F.col("dup").isNotNull(), "DEDUP_MERGED").when(replaces, "SUPERSEDED_INBAND").when(F.col("near").isNotNull() | inside.isNotNull(), "DEDUP_MERGED").otherwise("ADD")
    return f.withColumn("event", event).withColumn("target", F.coalesce("dup", "near", inside))


def supersede_documents(docs: DataFrame, newer: DataFrame, day: str) -> DataFrame:
    """``docs`` after ``newer`` (id, replaces): replaced ones are marked, new ones follow; both or neither are seen."""
    d = docs.join(newer.select(F.col("replaces").alias("id"), F.col("id").alias("by")), "id", "left")
    hit = F.col("by").isNotNull()
    marked = d.select(
        "id", F.when(hit, "superseded").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(day)).otherwise(F.col("invalidated_at")).alias("invalidated_at"),
        F.coalesce("by", "superseded_by").alias("superseded_by"),
    )
    none = F.lit(None).cast("string")
    return marked.unionByName(newer.select("id", F.lit("current").alias("status"), none.alias("invalidated_at"), none.alias("superseded_by")))


def import_decision(kind: Column) -> Column:
    return F.when(kind.isin(*KEEP), "keep").when(kind.isin(*DROP), "drop").otherwise("unjudged")


def stamp_fits(stamp: dict, provider: Column, model: Column, dimension: Column) -> Column:
    """Whether vectors were made as the stamp of an index says."""
    return provider.eqNullSafe(F.lit(stamp["provider"])) & model.eqNullSafe(F.lit(stamp["model"])) & dimension.eqNullSafe(F.lit(stamp["dimension"]))


def translate(rows: DataFrame, source: str) -> DataFrame:
    """Sessions of another system as documents: path and title, or the reason why a row is skipped."""
    mark = F.substring(F.sha2("session_id", 256), 1, 16)
    slug = F.nullif(T.project_slug(F.coalesce("project", F.lit(""))), F.lit(""))
    skipped = F.when(slug.isNull(), "no project")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.substring("summary", 1, 80), F.lit("")), F.concat(F.lit(f"{source}-"), mark))
    return rows.select(
        "session_id", skipped.alias("skipped"), F.when(slug.isNotNull(), F.concat(F.lit("sessions/"), slug, F.lit(f"/{source}-"), mark, F.lit(".md"))).alias("path"),
        F.when(slug.isNotNull(), F.regexp_replace(F.substring(title, 1, 200), "\n", " ")).alias("title"),
    )


def categories(lane: Column, stored: Column) -> Column:
    """The lane, then stored categories, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when(F.coalesce(lane, F.lit("")) != "", F.array(lane)).otherwise(none), F.coalesce(stored, none)))


# ---- Reactions --------------------------------------------------------------


def reaction_outcome(run: Column, message: Column, at: Column, count: Column, now: Column) -> Column:
    """invalid where a field is missing or too long, unaddressed where its time lies ahead, else valid."""
    sized = lambda c, n: F.coalesce(F.length(c).between(1, n), F.lit(False))
    ok = sized(run, 256) & sized(message, 128) & at.isNotNull() & F.coalesce(count >= 0, F.lit(False))
    ahead = F.unix_micros(at.cast("timestamp")) > F.unix_micros(now) + SKEW_S * 1_000_000
    return F.when(~ok, "invalid").when(ahead, "unaddressed").otherwise("valid")


def refs(column: Column) -> Column:
    """The references of a JSON column; null where it can't be read."""
    return F.from_json(column, _REF)


def update_ref(column: Column, old: str, new: str) -> Column:
    """The JSON column with one identifier replaced; what can't be read stays."""
    got = refs(column)
    moved = F.transform(got, lambda r: F.struct(F.when(r["id"] == old, F.lit(new)).otherwise(r["id"]).alias("id"), r["event"].alias("event")))
    return F.when(got.isNotNull() & column.startswith("["), F.to_json(moved)).otherwise(column)


def reaction_types(given: Column) -> Column:
    people = F.filter(given, lambda r: (r["count"] - r["own"].cast("bigint")) > 0)
    return F.array_distinct(F.transform(people, lambda r: r["kind"]))


def split_map(values: Column, reserved: tuple[str, ...]) -> tuple[Column, Column]:
    return F.map_filter(values, lambda k, v: k.isin(*reserved)), F.map_filter(values, lambda k, v: ~k.isin(*reserved))


# ---- Decision records -------------------------------------------------------


def decisions(files: DataFrame) -> DataFrame:
    """``key``, ``title``, ``status``, ``supersedes``, ``superseded_by`` from the front matter of (name, text) rows.

    ``supersedes`` is a block list, a list in brackets or one value; keys are the four digits a slug begins with.
    Files without a closed front matter or a key are left out.
    """
    head = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    scalar = lambda k: F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{k}:(.*)$", 1)), r"^([\"'])(.*)\1$", "$2")
    key = lambda c: F.nullif(F.regexp_extract(c, r"^\s*[\"']*(\d{4})", 1), F.lit(""))
    said = F.regexp_extract(head, r"(?m)^supersedes:[ \t]*(.*(?:\n[ \t]*-[ \t]+.*)*)", 1)
    listed = F.transform(F.regexp_extract_all(said, F.lit(r"(?:^|[\[,\n-])[ \t]*[\"']?(\d{4})"), F.lit(1)), lambda x: x)
    found = files.select(F.coalesce(key(scalar("id")), key(F.col("name"))).alias("key"), scalar("title").alias("title"), scalar("status").alias("status"), listed.alias("supersedes"), key(scalar("superseded_by")).alias("superseded_by"), head.alias("head"))
    return found.where("head <> '' AND key IS NOT NULL").drop("head")


def decision_graph(records: DataFrame) -> DataFrame:
    """Edges from a record to the one it replaces, told by either end, each once; ``dangling`` where an end is missing."""
    told = records.select(F.col("key").alias("src"), F.explode("supersedes").alias("dst"))
    told = told.unionByName(records.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("src"), F.col("key").alias("dst")))
    edges = told.where("src <> dst").distinct()
    known = records.select("key").distinct()
    edges = edges.join(known.withColumnRenamed("key", "src").withColumn("s", F.lit(1)), "src", "left").join(known.withColumnRenamed("key", "dst").withColumn("d", F.lit(1)), "dst", "left")
    return edges.select("src", "dst", (F.col("s").isNull() | F.col("d").isNull()).alias("dangling"))


# ---- Sizes and admission ----------------------------------------------------


def projected_bytes(n: Column, text_bytes: Column, dimension: int, links: int = 16, indexed_from: int = 20_000) -> Column:
    """Vectors, the links of the index once it is built, and texts."""
    return (n * dimension * 4 + F.when(n >= indexed_from, n * links * 8).otherwise(0) + text_bytes).cast("bigint")


def admitted(requests: DataFrame, per_minute: float = 60.0, burst: int = 10) -> DataFrame:
    """``event_id``, ``key``, ``ok``: whether each key's token bucket lets a request (event_id, key, ms) in, in order of time.

    A bucket holds ``burst`` tokens and fills by ``per_minute``.  Keys are folded one after another in sorted
    partitions, so no key's requests are held at once.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = object(), 0.0, 0
        for batch in batches:
            ok = []
            for k, ms in zip(batch["key"], batch["ms"], strict=True):
                if k != key:
                    key, tokens, last = k, float(burst), ms
                tokens = min(float(burst), tokens + (ms - last) * per_minute / 60_000)
                last = ms
                ok.append(tokens >= 1)
                tokens -= tokens >= 1
            yield batch[["event_id", "key"]].assign(ok=ok)

    return requests.repartition("key").sortWithinPartitions("key", "ms", "event_id").mapInPandas(fold, "event_id bigint, key string, ok boolean")
