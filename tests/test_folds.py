"""Writing in order against a plain loop, and late reactions as a stream against the batch join."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.operators import attribution, folds
from loomstead.plans import lifecycle
from loomstead.plans.tables import derived
from loomstead.streaming import reactions as late

FACT = "seq long, user_id string, lane string, persona string, hash string, vector array<double>, contradicts boolean, confidence double"


def one_by_one(facts, store, least, ceiling):
    """The same by comparing each fact with every current point of its arm."""
    held = [(s, arm, h, folds.unit(v)) for s, arm, h, v in store]
    out = []
    for seq, arm, h, v, contradicts, confidence in sorted(facts):
        v = folds.unit(v)
        mine = [p for p in held if p[1] == arm]
        same = [p for p in mine if h is not None and p[2] == h]
        if same:
            out.append((seq, "DEDUP_MERGED", min(p[0] for p in same)))
            continue
        scored = [(-round(float(p[3] @ v), folds.DIGITS), p[0]) for p in mine if v is not None and p[3] is not None]
        scored = [x for x in scored if -x[0] >= least]
        event, target = "ADD", None
        if scored:
            score, target = min(scored)
            if not ((arm[1] or arm[2]) and least <= -score <= ceiling and contradicts and (confidence or 0) >= 0.8):
                out.append((seq, "DEDUP_MERGED", target))
                continue
            event = "SUPERSEDED_INBAND"
            held = [p for p in held if p[0] != target]
        held.append((seq, arm, h, v))
        out.append((seq, event, target))
    return out


def as_rows(df):
    got = df.select("seq", "user_id", "lane", "persona", "hash", "vector", "contradicts", "confidence").collect()
    return [(r.seq, (r.user_id, r.lane, r.persona), r.hash, list(r.vector) if r.vector else None, r.contradicts, r.confidence) for r in got]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_add_in_order(spark, sf):
    facts, store = lifecycle.planted(derived(spark, f"/root/testdata/{sf}", "points"))
    got = sorted(tuple(r) for r in folds.add_in_order(facts, store).collect())
    held = [x[:4] for x in as_rows(store.where("status IS DISTINCT FROM 'superseded'").withColumns({"contradicts": F.lit(False), "confidence": F.lit(0.0)}))]
    want = one_by_one(as_rows(facts), held, 0.84, 0.95)
    assert got == sorted(want)
    events = [x[1] for x in want]
    assert all(events.count(e) >= 10 for e in ("ADD", "DEDUP_MERGED", "SUPERSEDED_INBAND"))
    assert any(t is not None and t in {x[0] for x in want} for _, _, t in want)  # facts of the batch met one another


def test_orders(spark):
    """One set of facts in 500 orders, each as the facts of a user of its own."""
    rng = np.random.default_rng(4)
    random.seed(4)
    base = rng.normal(size=(4, 8))
    vectors = [(base[i % 4] + 0.35 * rng.normal(size=8)).tolist() for i in range(12)] + [None, [0.0] * 8, base[0].tolist(), base[0].tolist()]
    rows = []
    for k in range(500):
        order = random.sample(range(len(vectors)), len(vectors))
        for place, i in enumerate(order):
            rows.append((k * 100 + place, f"u{k}", None if i % 5 == 4 and k % 2 else "l", None, None if i == 3 else f"h{i % 11}", vectors[i], i % 3 != 0, 0.9 if i % 2 else 0.8))
    facts = spark.createDataFrame(rows, FACT)
    store = facts.limit(0).withColumn("status", F.lit("current"))
    told = folds.add_in_order(facts, store)
    got = sorted(tuple(r) for r in told.collect())
    want = one_by_one([(r[0], r[1:4], *r[4:]) for r in rows], [], 0.84, 0.95)
    assert got == sorted(want) and {x[1] for x in want} == {"ADD", "DEDUP_MERGED", "SUPERSEDED_INBAND"}
    after = {r.seq: r for r in folds.store_after(store, facts, told).collect()}
    assert sum(r.merged for r in after.values()) == sum(x[1] == "DEDUP_MERGED" for x in want)
    assert {s for s, r in after.items() if r.status == "superseded"} == {x[2] for x in want if x[1] == "SUPERSEDED_INBAND"}


def test_no_facts(spark):
    facts = spark.createDataFrame([], FACT)
    assert folds.add_in_order(facts, facts.withColumn("status", F.lit("current"))).collect() == []


@pytest.fixture(scope="module")
def signals(spark):
    """Events of three weeks by day, and rows long after them that let all before settle."""
    sf = "/root/testdata/sf0.01"
    return derived(spark, sf, "reactions").withColumn("hash", F.col("user_id")), derived(spark, sf, "captures").withColumn("hashes", F.when(F.col("seq") % 2 == 0, F.array("user_id")))


def settled(spark, sink):
    rows = [(r.message_id, r.capture_id) for r in spark.read.parquet(sink).collect()]
    assert len(rows) == len({m for m, _ in rows})
    return sorted(rows, key=str)


@pytest.mark.parametrize("cuts, hashed", [(1, False), (3, False), (3, True)])
def test_late_reactions(spark, signals, tmp_path, cuts, hashed):
    r, c = signals
    if not hashed:
        r, c = r.drop("hash"), c.drop("hashes")
    bounds = c.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).first()
    low, high = bounds.a.timestamp() - 90000, bounds.b.timestamp() + 90000
    r_dir, c_dir, sink, checkpoint = (str(tmp_path / x) for x in ("r", "c", "sink", "checkpoint"))
    end = F.timestamp_seconds(F.lit(int(high) + 40 * 86400))
    rs, cs = r.schema, c.schema
    for i in range(cuts + 1):
        if i < cuts:
            span = lambda t, i=i: (F.unix_micros(t.cast("timestamp")) / 1e6 >= low + (high - low) * i / cuts) & (F.unix_micros(t.cast("timestamp")) / 1e6 < low + (high - low) * (i + 1) / cuts)
            r_part, c_part = r.where(span(F.col("ts"))), c.where(span(F.col("created_at")))
        else:
            r_part, c_part = r.limit(1).withColumn("ts", end.cast(rs["ts"].dataType)), c.limit(1).withColumn("created_at", end.cast(cs["created_at"].dataType))
        r_part.write.mode("append").parquet(r_dir)
        c_part.write.mode("append").parquet(c_dir)
        # Each round is a restart from the checkpoint.
        late.run_attachments(spark.readStream.schema(rs).parquet(r_dir), spark.readStream.schema(cs).parquet(c_dir), sink, checkpoint).awaitTermination()
    late.run_attachments(spark.readStream.schema(rs).parquet(r_dir), spark.readStream.schema(cs).parquet(c_dir), sink, checkpoint).awaitTermination()
    got = settled(spark, sink)
    batch = sorted(((x.message_id, x.capture_id) for x in late.attach_late(r, c).collect()), key=str)
    assert got == batch
    if not hashed:
        assert batch == sorted(((x.message_id, x.capture_id) for x in attribution.asof_reactions(r, c).collect()), key=str)
    else:
        assert batch != sorted(((x.message_id, x.capture_id) for x in attribution.asof_reactions(r, c).collect()), key=str)
