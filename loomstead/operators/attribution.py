"""Joins of the memory engine: duplicates, late reactions, pointers, aliases and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.recall import not_superseded
from loomstead.session import written

FORWARD_S, SKEW_S = 24 * 3600, 120  # fixed values: reach after and before a reaction


def exact_duplicates(facts: DataFrame, points: DataFrame) -> DataFrame:
    """The least current point with a fact's user, hash, lane and persona (absent equals absent)."""
    p = points.where(not_superseded()).groupBy("user_id", "hash", "lane", "persona").agg(F.min("seq").alias("duplicate_of"))
    keys = [F.col(f"f.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("user_id", "hash", "lane", "persona")]
    on = keys[0] & keys[1] & keys[2] & keys[3]
    return facts.alias("f").join(p.alias("p"), on, "left").select("f.seq", "duplicate_of")


def _beside(r: DataFrame, c: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """Rows of ``r`` (``keys``, run_id, at, further columns) with the captures of ``c`` (``keys``, run_id, at, capture_id) that stand next to them:
    ``own_before``, ``own_after``, ``any_before`` and ``any_after``, of their own run and of those without a run.

    Both sides lie in buckets of ``size`` microseconds in order of time, with the first capture of the bucket after and the
    last of the one before; so what lies further off than ``size`` may be missing.  Rows are sorted, never paired.
    """
    of = F.floor(F.col("at") / size)
    for k in (*keys, "at", "capture_id"):
        c = c.where(F.col(k).isNotNull())
    c = c.select(*keys, "run_id", "at", "capture_id", of.alias("bucket"))
    ends = c.groupBy(*keys, "run_id", "bucket").agg(F.min(F.struct("at", "capture_id")).alias("first"), F.min(F.struct((-F.col("at")).alias("at"), "capture_id")).alias("last"))
    first = F.struct((F.col("bucket") - 1).alias("bucket"), F.col("first.at").alias("at"), F.col("first.capture_id").alias("capture_id"))
    last = F.struct((F.col("bucket") + 1).alias("bucket"), (-F.col("last.at")).alias("at"), F.col("last.capture_id").alias("capture_id"))
    c = c.unionByName(ends.select(*keys, "run_id", F.inline(F.array(first, last))))
    # Reactions without a key or a time meet nothing, wherever they lie.
    placed = F.col("at").isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    others = [x for x in r.columns if x not in keys]
    r = r.select(*others, *(F.when(placed, F.col(k)).alias(k) for k in keys), F.when(placed, of).otherwise(F.xxhash64(*others)).alias("bucket"), F.lit(True).alias("asks"))
    # One shuffle serves both tiers: a run's rows lie where those of its keys and bucket lie.
    rows = r.unionByName(c, allowMissingColumns=True).repartition(*keys, "bucket").withColumn("c", F.when(F.col("asks").isNull(), F.struct("at", "capture_id")))
    tiers = {"own": (F.when(F.col("run_id").isNotNull(), F.col("c")), ("run_id",)), "any": (F.when(F.col("run_id").isNull(), F.col("c")), ())}
    for name, (capture, by) in tiers.items():
        group = Window.partitionBy(*keys, "bucket", *by)
        # The last capture seen on the way up lies before a reaction, on the way down at or after it; of one time the least id comes last.
        ways = {"before": (F.col("at"), F.col("asks").desc_nulls_last()), "after": (F.col("at").desc(), F.col("asks").asc_nulls_first())}
        for way, order in ways.items():
            w = group.orderBy(*order, F.col("capture_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = rows.withColumn(f"{name}_{way}", F.last(capture, ignorenulls=True).over(w))
    return rows.where("asks")


def _best(*reach: tuple[str, int], unlike: bool = True) -> Column:
    """Of the captures beside a reaction the one that counts: by tier, then by the ways named, each up to so many seconds."""

    def near(tier: str, way: str, most: int) -> Column:
        gap = F.abs(F.col(f"{tier}_{way}.at") - F.col("at"))
        parts = {"tier": F.lit(tier == "any"), "unlike": F.lit(unlike), "late": F.lit(way == "before"), "gap": gap, "capture_id": F.col(f"{tier}_{way}.capture_id")}
        return F.when(gap <= most * 1_000_000, F.struct(*(v.alias(k) for k, v in parts.items())))

    return F.coalesce(*(near(tier, *x) for tier in ("own", "any") for x in reach))


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def asof_reactions(reactions: DataFrame, captures: DataFrame, bucket_s: int = FORWARD_S) -> DataFrame:
    """Capture of each reaction: the earliest at or after it within a day, else the latest in the two
    minutes before; captures of its own run come before those without a run.  A row a message.  Buckets of a day at least.
    """
    if bucket_s < FORWARD_S:
        raise ValueError(f"a bucket holds {FORWARD_S} seconds at least")
    r = reactions.select("message_id", "user_id", "run_id", micros("ts").alias("at"))
    c = captures.select("user_id", "run_id", micros("created_at").alias("at"), "capture_id")
    beside = _beside(r, c, ("user_id",), bucket_s * 1_000_000)
    best = F.min(_best(("after", FORWARD_S), ("before", SKEW_S)))
    return beside.groupBy("message_id").agg(best.alias("best")).select("message_id", F.col("best.capture_id").alias("capture_id"))


def attach_reactions(r: DataFrame, c: DataFrame) -> DataFrame:
    """``message_id``, ``user_id``, ``at`` and ``capture_id`` of each reaction (message_id, user_id, run_id, at, hash): as in ``asof_reactions``,
    but of one tier a capture (user_id, run_id, at, capture_id, hashes) that holds the hash comes first, the earliest such within reach."""
    who = F.struct("message_id", "user_id", "at").alias("who")
    plain = _beside(r.select("user_id", "run_id", "at", who), c.drop("hashes"), ("user_id",), FORWARD_S * 1_000_000)
    found = plain.select("who", _best(("after", FORWARD_S), ("before", SKEW_S)).alias("best"))
    # The earliest from the reach's beginning on.
    begin = r.where("hash IS NOT NULL").select("user_id", "hash", "run_id", (F.col("at") - SKEW_S * 1_000_000).alias("at"), who)
    held = c.select("user_id", "run_id", "at", "capture_id", F.explode(F.array_distinct("hashes")).alias("hash"))
    alike = _beside(begin, held, ("user_id", "hash"), (FORWARD_S + SKEW_S) * 1_000_000)
    found = found.unionByName(alike.select("who", _best(("after", FORWARD_S + SKEW_S), unlike=False).alias("best")))
    return found.groupBy("who").agg(F.min("best").alias("best")).select("who.*", F.col("best.capture_id").alias("capture_id"))


def override_by_hash(placed: DataFrame, reactions: DataFrame, captures: DataFrame) -> DataFrame:
    """``placed``, but a capture of the same user among whose ``hashes`` a reaction's ``hash`` is comes first (the least id of several)."""
    held = captures.select("user_id", "capture_id", F.explode("hashes").alias("hash")).groupBy("user_id", "hash").agg(F.min("capture_id").alias("by_hash"))
    found = reactions.select("message_id", "user_id", "hash").join(held, ["user_id", "hash"]).groupBy("message_id").agg(F.min("by_hash").alias("by_hash"))
    return placed.join(found, "message_id", "left").select("message_id", F.coalesce("by_hash", "capture_id").alias("capture_id"))


def resolve_by_hash(refs: DataFrame, points: DataFrame) -> DataFrame:
    """A reference (``ref_id``, ``user_id``, ``hash``) by id, else by user and hash."""
    by_id = points.select(F.col("id").alias("ref_id"), F.col("seq").alias("direct"))
    by_hash = points.groupBy("user_id", "hash").agg(F.min("seq").alias("fallback"))
    return refs.join(by_id, "ref_id", "left").join(by_hash, ["user_id", "hash"], "left").select("ref_id", F.coalesce("direct", "fallback").alias("seq"))


def chase(points: DataFrame, hops: int = 8) -> DataFrame:
    """Terminal point of each: superseded_by is followed to a point that is not superseded; a dead end,
    a cycle or more than ``hops`` steps end in null."""
    step = points.select("id", "status", "superseded_by")
    # Paths double with every round, so eight hops take four self-joins.
    state = step.select(
        "id",
        F.when(~F.col("status").eqNullSafe("superseded"), F.col("id")).alias("terminal"),
        F.when(F.col("status").eqNullSafe("superseded"), F.col("superseded_by")).alias("next"),
        F.when(F.col("status").eqNullSafe("superseded"), 1).otherwise(0).alias("steps"),
    )
    done = 1
    while done <= hops:
        ahead = state.select(F.col("id").alias("next"), F.col("terminal").alias("t2"), F.col("next").alias("n2"), F.col("steps").alias("s2"))
        state = written(
            state.join(ahead, "next", "left").select(
                "id", F.coalesce("terminal", "t2").alias("terminal"), F.when(F.col("terminal").isNull() & F.col("t2").isNull(), F.col("n2")).alias("next"),
                (F.col("steps") + F.when(F.col("terminal").isNull(), F.coalesce("s2", F.lit(0))).otherwise(0)).alias("steps"),
            )
        )
        done *= 2
    return state.select("id", F.when(F.col("steps") <= hops, F.col("terminal")).alias("terminal"))


def prunable(captures: DataFrame, reactions: DataFrame, attached: DataFrame) -> DataFrame:
    """Captures that neither a reaction nor an attachment names."""
    return captures.join(reactions.select("capture_id"), "capture_id", "left_anti").join(attached.select("capture_id"), "capture_id", "left_anti")


def classify_reacted(captures: DataFrame, reacted: DataFrame) -> DataFrame:
    """``class``: reacted (sum above 0), zeroed (sum 0) or unreacted."""
    total = reacted.groupBy("capture_id").agg(F.sum("n").alias("total"))
    kind = F.when(F.col("total").isNull(), "unreacted").when(F.col("total") > 0, "reacted").otherwise("zeroed")
    return captures.join(total, "capture_id", "left").withColumn("class", kind)


def earliest_reference(captures: DataFrame) -> DataFrame:
    return captures.groupBy("point_id").agg(F.min_by("capture_id", F.struct("created_at", "capture_id")).alias("capture_id"))


def override(judged: DataFrame, decided: DataFrame, key: str, value: str) -> DataFrame:
    """Rows decided by the user replace those of the judge."""
    d = decided.select(key, F.col(value).alias("_by_user"))
    return judged.join(d, key, "left").withColumn(value, F.coalesce("_by_user", value)).drop("_by_user")


def resume(everything: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return everything.join(done.select(key).distinct(), key, "left_anti")


def union_set(old: Column, new: Column) -> Column:
    """``old`` with ``new`` appended if absent; null where both are empty."""
    merged = F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.when(new.isNull(), F.array().cast("array<string>")).otherwise(F.array(new))))
    return F.when(F.size(merged) > 0, merged)


def point_reactions(attached: DataFrame) -> DataFrame:
    """Sum of the reactions of a point's distinct captures, and their kinds in order of first attachment."""
    state = attached.groupBy("capture_id", "message_id").agg(F.max_by(F.struct("n", "kind"), "seq").alias("s"))
    links = attached.groupBy("point_id", "capture_id").agg(F.min("seq").alias("first"))
    met = links.join(state, "capture_id")
    kinds = F.array_sort(F.collect_list(F.struct("first", "message_id", F.col("s.kind").alias("kind"))))
    return met.groupBy("point_id").agg(F.sum("s.n").alias("reaction_count"), F.array_join(F.array_distinct(F.transform(kinds, lambda x: x["kind"])), ",").alias("kinds"))


# Messages a capture keeps, the highest count and the number and length of kinds a point shows.
MESSAGES, MOST, KINDS, KIND_CHARS = 64, 1000, 16, 64


def reaction_state(placed: DataFrame, messages: int = MESSAGES) -> tuple[DataFrame, DataFrame]:
    """State of each capture's messages and the rows refused, from (capture_id, message_id, seq, n, kind) in order of ``seq``.

    The last count of a message stands; a message that would be one too many
    for its capture is refused, whenever it comes again.
    """
    last = placed.groupBy("capture_id", "message_id").agg(F.min("seq").alias("first"), F.max_by(F.struct("n", "kind"), "seq").alias("s"))
    place = F.row_number().over(Window.partitionBy("capture_id").orderBy("first"))
    kept = last.withColumn("place", place).where(F.col("place") <= messages).select("capture_id", "message_id", "s.n", "s.kind")
    return kept, placed.join(kept.select("capture_id", "message_id"), ["capture_id", "message_id"], "left_anti")


def annotate_points(state: DataFrame, refs: DataFrame, points: DataFrame) -> DataFrame:
    """``id``, ``reaction_count`` and ``reaction_types`` of each point that the reactions of its captures reach.

    A capture's requested points (capture_id, point_id, seq) are followed to the
    points that stand for them now; the captures of one such point add up,
    each once; kinds come in order of attachment, then of message.  A sum of
    nothing writes nothing, and what is written keeps within bounds.
    """
    ends = chase(points).where("terminal IS NOT NULL").withColumnRenamed("id", "point_id")
    held = refs.join(ends, "point_id").groupBy("terminal", "capture_id").agg(F.min("seq").alias("first"))
    met = held.join(state, "capture_id")
    total = met.groupBy("terminal").agg(F.sum("n").alias("total")).where("total >= 1")
    kinds = met.where("kind IS NOT NULL").groupBy("terminal", "kind").agg(F.min(F.struct("first", "message_id")).alias("at"))
    some = kinds.withColumn("k", F.row_number().over(Window.partitionBy("terminal").orderBy("at"))).where(F.col("k") <= KINDS)
    told = some.groupBy("terminal").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "kind"))), lambda x: F.substring(x["kind"], 1, KIND_CHARS)).alias("reaction_types"))
    return total.join(told, "terminal", "left").select(F.col("terminal").alias("id"), F.least("total", F.lit(MOST)).alias("reaction_count"), "reaction_types")


def merge_older(facts: DataFrame) -> DataFrame:
    """Duplicates of one user, hash, lane and persona fold into the oldest: its text stays, projects are
    united in order, the count grows."""
    in_order = F.array_sort(F.collect_list(F.when(F.nullif("project", F.lit("")).isNotNull(), F.struct("seq", "project"))))
    return facts.groupBy("user_id", "hash", "lane", "persona").agg(
        F.min("seq").alias("seq"), F.min_by("data", "seq").alias("data"), F.count("*").alias("dedup_count"), F.max("seq").alias("last_seen"),
        F.array_join(F.array_distinct(F.transform(in_order, lambda x: x["project"])), ",").alias("projects"),
    )


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc()))).where("_r = 1").drop("_r")
