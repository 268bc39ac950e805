"""What larger tables need: rows that are shuffled follow the input, not its pairs or copies; results are those of the plain method."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.operators import attribution, measures, retrieval


def moved(df, metric="shuffleRecordsWritten", nodes=""):
    """Rows that the query's own exchanges write, or another count of its nodes of one kind."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if nodes in kind and node.metrics().contains(metric):
                n += node.metrics().apply(metric).value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_permutations_are_not_copied(spark):
    rng = random.Random(5)
    rows = [(i, f"w{i % 5}", (i % 7 == 0 and i % 5 != 3) or i % 5 == 4, None if i % 9 == 0 else rng.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "k bigint, week string, case boolean, value double")
    each = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(99)))).withColumn("cases", F.sum(F.col("case").cast("int")).over(Window.partitionBy("week", "round")))
    place = F.row_number().over(Window.partitionBy("week", "round").orderBy(F.xxhash64("k", "round"), "k"))
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    dealt = each.withColumn("said", place <= F.col("cases")).groupBy("round").agg((mean(F.col("said")) - mean(~F.col("said"))).alias("d"))
    seen = df.agg((mean(F.col("case")) - mean(~F.col("case"))).alias("d")).first().d
    made = measures.permutation_test(df, rounds=99)
    got = made.first()
    assert got.observed == round(seen, 6) and got.p == round((sum(r.d >= seen for r in dealt.collect()) + 1) / 100, 6)
    assert moved(made) < 10_000  # of 99,000 copies


def test_hard_negatives_by_sets(spark):
    """Many rows with few sets of terms, some with a term twice, one in two lanes."""
    rng = random.Random(6)
    rows = [(k, f"l{k % 2}", t) for k in range(400) for t in rng.choice(["ab", "abc", "aab", "xyz", "bx", "cz"])]
    rows += [(7, "l0", "q"), (400, "l0", "q"), (401, "l1", "alone"), (402, None, "a"), (403, "l0", None), (404, "l5", "v"), (406, "l5", "v"), (408, "l5", "v"), (408, "l5", "w")]
    terms = spark.createDataFrame(rows, "k bigint, lane string, term string")
    want = {}
    for q in {k for k, _, _ in rows if k % 2 == 0 or k in (7, 401)}:
        n = {}
        for k, lane, t in rows:
            for k2, lane2, t2 in rows if k == q and lane and t else ():
                if k2 != q and (lane2, t2) == (lane, t):
                    n[k2] = n.get(k2, 0) + 1
        if n:
            want[q] = min((-c, k) for k, c in n.items())
    made = measures.hard_negatives(terms.where("k % 2 = 0 OR k IN (7, 401)"), terms)
    assert {r.query: (-r.shared, r.negative) for r in made.collect()} == want
    assert moved(made) < 5_000  # rows met by rows: 27,489


def _pick(r, captures):
    """The capture of a reaction (message, user, run, second), by all pairs."""
    met = [(c[2] is None, c[3] < r[3], abs(c[3] - r[3]), c[0]) for c in captures if None not in (c[1], r[1], c[3], r[3]) and c[1] == r[1] and (c[2] is None or c[2] == r[2]) and r[3] - 120 <= c[3] <= r[3] + 86400]
    return min(met)[3] if met else None


def _events(spark, seed, n, span):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.01 else 86400 * 19723 + rng.randrange(-span, span) // 40 * 40
    some = lambda *x: rng.choice(x)
    reactions = [(f"m{i}", some("a", "b", "b", "b", None), some("r1", "r2", None), at()) for i in range(n)]
    captures = [(f"c{rng.randrange(10**6)}", some("a", "b", "b", "b", None), some("r1", "r2", "r3", None), at()) for i in range(n)]
    made = lambda rows, key, time: spark.createDataFrame(rows, f"{key} string, user_id string, run_id string, s bigint").withColumn(time, F.timestamp_seconds("s"))
    return reactions, captures, made(reactions, "message_id", "ts"), made(captures, "capture_id", "created_at")


def test_asof_rows_are_not_paired(spark):
    for seed, n, span in ((1, 300, 400), (2, 300, 100_000), (3, 120, 600_000)):
        reactions, captures, r, c = _events(spark, seed, n, span)
        got = {x.message_id: x.capture_id for x in attribution.asof_reactions(r, c).collect()}
        assert got == {x[0]: _pick(x, captures) for x in reactions}
    # The picks at both ends of a reach, and a message that is told twice (the nearer counts, as in SQL).
    rows = [("m1", "a", "r", 86400), ("m2", "b", "r", 86399), ("m3", "c", "r", 120), ("m4", "d", "r", 86460), ("m5", "e", "r", 100), ("m5", "e", "r", 200)]
    held = [("c1", "a", "r", 172800), ("c2", "b", "r", 172800), ("c3", "c", "r", 0), ("c4", "d", "r", 86339), ("c5", "e", None, 200)]
    r = spark.createDataFrame(rows, "message_id string, user_id string, run_id string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    c = spark.createDataFrame(held, "capture_id string, user_id string, run_id string, s bigint").withColumn("created_at", F.timestamp_seconds("s"))
    assert sorted(attribution.asof_reactions(r, c).collect()) == [("m1", "c1"), ("m2", None), ("m3", "c3"), ("m4", None), ("m5", "c5")]
    # 4,000 rows of one user and hour: they are shuffled once or twice, no row meets all others.
    one = lambda key, time: spark.range(2000).select(F.concat(F.lit(key[0]), "id").alias(key), F.lit("a").alias("user_id"), F.lit("r").alias("run_id"), F.timestamp_seconds(F.col("id")).alias(time))
    made = attribution.asof_reactions(one("message_id", "ts"), one("capture_id", "created_at"))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and moved(made) < 20_000


def test_late_reactions_are_not_paired(spark):
    from loomstead.streaming import reactions as late

    for seed, span in ((4, 300), (5, 100_000)):
        reactions, captures, r, c = _events(spark, seed, 200, span)
        marks = ("x", "y", None)
        hash_of = {x[0]: marks[i % 3] for i, x in enumerate(reactions)}
        held = [[h for j, h in enumerate(marks[:2]) if (i >> j) & 1] if i % 5 else None for i in range(len(captures))]
        r = r.join(spark.createDataFrame(list(hash_of.items()), "message_id string, hash string"), "message_id")
        c = spark.createDataFrame([(*x, h) for x, h in zip(captures, held, strict=True)], "capture_id string, user_id string, run_id string, s bigint, hashes array<string>").withColumn("created_at", F.timestamp_seconds("s"))
        want = {}
        for m, user, run, at in (x for x in reactions if x[3] is not None):
            met = []
            for (cid, c_user, c_run, c_at), h in zip(captures, held, strict=True):
                if c_at is not None and user is not None and c_user == user and (c_run is None or c_run == run) and at - 120 <= c_at <= at + 86400:
                    same = hash_of[m] is not None and hash_of[m] in (h or ())
                    met.append((c_run is None, not same, not same and c_at < at, c_at - at if same else abs(c_at - at), cid))
            want[m] = min(met)[4] if met else None
        made = late.attach_late(r, c)
        assert {x.message_id: x.capture_id for x in made.collect()} == want
    one = lambda key, time: spark.range(1000).select(F.concat(F.lit(key[0]), "id").alias(key), F.lit("a").alias("user_id"), F.lit("r").alias("run_id"), F.timestamp_seconds(F.col("id")).alias(time))
    made = late.attach_late(one("message_id", "ts"), one("capture_id", "created_at"))
    assert moved(made) < 20_000 and moved(made, "numOutputRows", "Join") == 0  # most of 1,000,000 pairs are within reach


def test_hashes_are_not_paired(spark):
    r = spark.range(500).select(F.concat(F.lit("m"), "id").alias("message_id"), F.lit("a").alias("user_id"), (F.col("id") % 2).cast("string").alias("hash"))
    c = spark.range(500).select(F.concat(F.lit("c"), F.col("id") + 100).alias("capture_id"), F.lit("a").alias("user_id"), F.array((F.col("id") % 3).cast("string")).alias("hashes"))
    made = attribution.override_by_hash(r.select("message_id", F.lit(None).cast("string").alias("capture_id")), r, c)
    assert {(int(x.message_id[1:]) % 2, x.capture_id) for x in made.collect()} == {(0, "c100"), (1, "c101")}
    assert moved(made, "numOutputRows", "Join") < 5_000  # of 83,500 pairs


def test_few_grams_leave_their_documents(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(("the", "a", "Über", "x_1", "9", "K", "naïve", "dog's", "İs", "z"))
    texts = [None, "", "a b", " - a b c d e - ", *(" ".join(word() for _ in range(rng.randrange(40))) for _ in range(300))]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    others = spark.createDataFrame([(t,) for t in [None, "A, B, c. D e f", *texts[20:40], *(" ".join(word() for _ in range(9)) for _ in range(20))]], "text string")
    grams = lambda df: df.select("*", F.explode(T.ngrams(F.col("text"), 5)).alias("gram"))
    want = grams(docs).join(grams(others).select("gram").distinct(), "gram").groupBy("doc_id").agg(F.countDistinct("gram").alias("shared"))
    made = retrieval.shared_grams(docs, others, 5)
    assert sorted(made.collect()) == sorted(want.collect())
    assert made.schema == want.schema
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_filter_of_grams(spark):
    """Of 60,000 runs of words that a filter sees, those that nothing has stay where they are."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: F.concat(F.lit("w"), (F.col("id") * 100 + i).cast("string"))), " ").alias("text"))
    made = retrieval.shared_grams(docs, docs.where("doc_id < 3").select("text"), 5)
    assert sorted(made.collect()) == [(0, 30), (1, 30), (2, 30)]
    assert moved(made, "numOutputRows", "MapInArrow") < 6_000
