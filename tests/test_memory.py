"""Functions, sources and streams of the memory engine."""

import json
import random
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.functions.temporal import parse_window
from loomstead.operators import attribution, recall
from loomstead.operators.components import connected_components
from loomstead.sources import vault
from loomstead.streaming import turns

NOW = datetime(2024, 3, 31, 12, tzinfo=UTC)


@pytest.mark.parametrize(
    "query, kind, start",
    [
        ("what happened on 2024-02-29", "on_date", "2024-02-29"), ("since 2024-01-05 please", "since_date", "2024-01-05"), ("trips in March", "in_month", "2024-03-01"),
        ("trips in May", "in_month", "2023-05-01"), ("last 3 days", "last_n", "2024-03-28"), ("past 1 month", "last_n", "2024-02-29"), ("yesterday", "yesterday", "2024-03-30"),
        ("today", "today", "2024-03-31"), ("last week", "last_week", "2024-03-18"), ("this week", "this_week", "2024-03-25"), ("last month", "last_month", "2024-02-01"),
        ("this month", "this_month", "2024-03-01"), ("last year", "last_year", "2023-01-01"), ("this year", "this_year", "2024-01-01"),
    ],
)
def test_windows(query, kind, start):
    w = parse_window(query, NOW)
    assert (w.kind, w.start.date().isoformat()) == (kind, start)


@pytest.mark.parametrize("query", ["on 2026-02-31 or yesterday", 'said "yesterday"', "nothing", "x" * 512 + " yesterday", "last 999999 years"])
def test_no_window(query):
    assert parse_window(query, NOW) is None


def test_text_functions(spark):
    one = spark.createDataFrame([("Ünïcode Títle!", "a [[B|x]] [[ c#h ]] [[B]]", "python.org", '```json\n{"contradicts": true, "confidence": 0.9}\n```', "no json")], "t string, w string, n string, v string, bad string")
    r = one.select(
        T.title_slug(F.col("t")).alias("slug"), T.wiki_links(F.col("w")).alias("links"), T.uuid5(F.col("n")).alias("id"), T.verdict(F.col("v")).alias("v"), T.verdict(F.col("bad")).alias("bad"),
        T.leaks(F.lit("one two three four"), F.lit("x two three four")).alias("leak"), T.snowflake_time(F.lit(175928847299117063)).alias("at"),
    ).first()
    assert r.slug == "unicode-title" and r.links == ["B", "c"] and r.id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org"))
    assert r.v.contradicts and not r.bad.contradicts and r.bad.confidence == 0 and r.leak and r["at"].year == 2016


def test_vault_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("---\nid: x\ntitle: T: 1\n---\nbody\n")
    (tmp_path / "a/y.md").write_text("no header")
    (tmp_path / "a/z.txt").write_text("other")
    got = {r.doc_id: r for r in vault.read_vault(spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "y"} and got["x"].front_matter == {"id": "x", "title": "T: 1"} and got["x"].body == "body\n"
    assert got["y"].front_matter == {} and got["y"].body == "no header"
    made = vault.read_vault(spark, str(tmp_path)).where("doc_id = 'x'").select(vault.render(F.col("front_matter"), F.col("body")).alias("r")).first().r
    assert made == "---\nid: x\nsource: native\ntitle: T: 1\n---\nbody\n"


def test_filters_reject_unknown():
    for bad in ({"size": 1}, {"AND": [{"OR": []}]}, {"AND": [], "user_id": "x"}):
        with pytest.raises((ValueError, AttributeError)):
            recall.parse_filters(bad)


@pytest.mark.parametrize("value, want", [("5", 5), (0, None), (-1, None), ("x", None), (float("inf"), None), (1e9, 100), (None, None)])
def test_limits(value, want):
    assert recall.coerce_limit(value) == want


def test_chase_ends(spark):
    points = [("a", "superseded", "b"), ("b", None, None), ("c", "superseded", "d"), ("d", "superseded", "c"), ("e", "superseded", "gone")]
    points += [(f"l{i}", "superseded", f"l{i + 1}") for i in range(9)] + [("l9", "current", None)]
    got = {r.id: r.terminal for r in attribution.chase(spark.createDataFrame(points, "id string, status string, superseded_by string")).collect()}
    assert got["a"] == "b" and got["c"] is None and got["e"] is None
    assert got["l1"] == "l9" and got["l0"] is None  # eight hops, and nine


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_stream_is_idempotent(spark, tmp_path):
    src, sink, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    turn = lambda i, d=1: json.dumps({"project": "p", "turn_iso": f"2024-01-0{d}T00:00:{i:02d}Z", "role": "user", "content": "x" * 300})
    (src / "1.json").write_text("\n".join(turn(i) for i in range(6)) + "\n" + turn(0) + '\n{"project": "p", "turn_iso": "bad", "role": "user", "content": "y"}\n')
    for _ in range(2):
        turns.run_checkpoints(turns.read_turns(spark, str(src)), sink, mark, budget=1000).awaitTermination()
    got = turns.read_summaries(spark, sink).orderBy("start").collect()
    assert [r.turns for r in got] == [3, 3]
    (src / "2.json").write_text("\n".join(turn(i, 2) for i in range(2)) + "\n")
    turns.run_checkpoints(turns.read_turns(spark, str(src)), sink, mark, budget=1000).awaitTermination()
    assert turns.read_summaries(spark, sink).count() == 3


def test_token_bucket_matches_a_sequential_fold(spark):
    from loomstead.operators.writes import admitted

    rng = random.Random(2)
    rows = [(i, f"k{rng.randrange(4)}", rng.randrange(600_000)) for i in range(400)]
    got = {r.event_id: r.ok for r in admitted(spark.createDataFrame(rows, "event_id bigint, key string, ms bigint").repartition(3), per_minute=6.0, burst=3).collect()}
    state, want = {}, {}
    for i, k, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(k, (3.0, ms))
        tokens = min(3.0, tokens + (ms - last) * 6.0 / 60_000)
        want[i] = tokens >= 1
        state[k] = (tokens - want[i], ms)
    assert got == want and 0 < sum(got.values()) < 400


def test_resampling_is_calibrated(spark):
    from loomstead.operators.measures import bootstrap_f_half, permutation_test

    rng = random.Random(8)
    rows = [(i, rng.random() < 0.5, rng.random() < 0.5) for i in range(800)]
    tp = sum(s and t for _, s, t in rows)
    f = 1.25 * tp / (1.25 * tp + 0.25 * sum(t and not s for _, s, t in rows) + sum(s and not t for _, s, t in rows))
    r = bootstrap_f_half(spark.createDataFrame(rows, "k bigint, said boolean, true boolean"), replicates=100).first()
    assert r.lo < f < r.hi and abs(r.mean - f) < 0.02 and 0.03 < r.hi - r.lo < 0.15
    rows = [(i, f"w{i % 5}", i % 7 == 0, rng.random() + (0.3 if i % 7 == 0 else 0)) for i in range(500)]
    schema = "k bigint, week string, case boolean, value double"
    strong = permutation_test(spark.createDataFrame(rows, schema), rounds=99).first()
    none = permutation_test(spark.createDataFrame([(i, w, rng.random() < 0.2, v) for i, w, _, v in rows], schema), rounds=99).first()
    assert strong.p == 0.01 and none.p > 0.02 and strong.observed > 0.15


def test_wide_columns_of_text(spark):
    from loomstead.functions import text as T

    text = "é€😀a\n" * 700
    r = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.byte_pieces(F.col("t"), 64).alias("p")).collect()
    assert "".join(r[0].p) == text and max(len(x.encode()) for x in r[0].p) <= 64 and r[1].p == [] and not r[2].p


def test_messages_of_a_capture_are_capped(spark):
    rows = [("c", f"m{i}", i, 1, "heart") for i in range(70)] + [("c", "m3", 100, 5, "star"), ("c", "m69", 101, 9, "star"), ("d", "m1", 5, 2, None)]
    kept, refused = attribution.reaction_state(spark.createDataFrame(rows, "capture_id string, message_id string, seq long, n long, kind string"))
    got = {(r.capture_id, r.message_id): (r.n, r.kind) for r in kept.collect()}
    assert len(got) == 65 and got["c", "m3"] == (5, "star") and got["d", "m1"] == (2, None) and ("c", "m64") not in got
    assert sorted((r.message_id, r.seq) for r in refused.collect()) == sorted([*((f"m{i}", i) for i in range(64, 70)), ("m69", 101)])


def test_annotated_points_stay_in_bounds(spark):
    state = spark.createDataFrame([("c1", f"m{i:02d}", 60, f"{i:02d}" + "x" * 80) for i in range(20)] + [("c2", "z", 0, "none"), ("c3", "y", 1, None)], "capture_id string, message_id string, n long, kind string")
    refs = spark.createDataFrame([("c1", "old", 1), ("c1", "new", 2), ("c2", "zero", 3), ("c3", "gone", 4), ("c3", "plain", 5)], "capture_id string, point_id string, seq long")
    points = spark.createDataFrame([("old", "superseded", "new"), ("new", None, None), ("zero", None, None), ("gone", "superseded", "lost"), ("plain", None, None)], "id string, status string, superseded_by string")
    got = {r.id: (r.reaction_count, r.reaction_types) for r in attribution.annotate_points(state, refs, points).collect()}
    assert got["new"][0] == 1000 and len(got["new"][1]) == 16 and all(len(k) == 64 for k in got["new"][1]) and got["new"][1][0].startswith("00x")
    assert got["plain"] == (1, None) and got.keys() == {"new", "plain"}


@pytest.mark.parametrize("path", ["../x.md", "/etc/x.md", "a/../../x.md", "x.txt", "a\x00.md"])
def test_paths_out_of_the_vault(path):
    with pytest.raises(ValueError, match="below the vault"):
        vault.inside("/vault", path)
    assert vault.inside("/vault", "a/../b/x.md") == "/vault/b/x.md"


def test_vault_writes_replace_whole_files(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    vault.write_vault(docs(("a/x.md", "one"), ("y.md", "two")), str(tmp_path))
    vault.write_vault(docs(("a/x.md", "three"), ("b/z.md", None)), f"file://{tmp_path}")
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"a/x.md": "three", "y.md": "two", "b/z.md": ""}
    with pytest.raises(Exception, match="below the vault"):
        vault.write_vault(docs(("../x.md", "no")), str(tmp_path / "a"))
