"""Segmented scans and quantiles against windows and numpy, with a key that spans all ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstead.operators import graph
from loomstead.operators.scan import quantiles, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    keys = ["hot"] * 700 + [None] * 90 + [f"k{i % 40}" for i in range(300)]
    data = [(k, i, rng.choice([None, rng.randint(-50, 50)]), float(rng.randint(0, 9))) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, at long, v long, x double")


@pytest.mark.parametrize("how, plain", [("max", F.max), ("sum", F.sum), ("last", lambda c: F.last(c, ignorenulls=True))])
def test_running(rows, how, plain):
    got = running(rows, ["key"], ["at"], F.col("v"), how, "out")
    assert got.columns == [*rows.columns, "out"]
    window = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.withColumn("out", plain("v").over(window)).collect()), key=str)
    assert "windowspecdefinition(_running_part" in got._jdf.queryExecution().toString()  # rows run within ranges
    assert running(rows.limit(0), ["key"], ["at"], F.col("v"), how, "out").collect() == []


@pytest.mark.parametrize("interpolated", [False, True])
def test_quantiles(rows, interpolated):
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    more = rows.union(rows.limit(3).select("key", "at", "v", F.lit(float("nan")))).union(rows.limit(3).select("key", "at", "v", F.lit(None)))
    got = {r.key: r for r in quantiles(more, ["key"], "x", shares, interpolated=interpolated).collect()}
    held = {}
    for r in rows.collect():
        held.setdefault(r.key, []).append(r.x)
    assert got.keys() == held.keys()
    for k, values in held.items():
        for name, share in shares.items():
            want = np.quantile(values, share, method="linear" if interpolated else "inverted_cdf")
            assert abs(got[k][name] - want) < 1e-9, (k, name)


def test_densest(spark):
    edges = [("hub", f"leaf{i}") for i in range(9)] + [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"), ("b", "d"), ("d", "a"), ("x", "x")]
    got = graph.densest(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {(r.note, r.interlinks, r.ring) for r in got} == {("a", 3, 3)}  # not the hub with most neighbours
    assert {(r.src, r.dst) for r in got} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert graph.densest(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_spellings(spark):
    notes = spark.createDataFrame([("My-Note", "my_file-1.md"), ("other_note", "other_note.md"), ("alpha", "my-note.md")], "key string, file string")
    asked = {"my-note": "My-Note", "MY_NOTE": "My-Note", "my-file-1": "My-Note", "My_File_1": "My-Note", "my_file-1": "My-Note", "other-note": "other_note", "none": None, "alpha": "alpha"}
    links = spark.createDataFrame([(f"from {t}", t) for t in asked], "src string, target string")
    met, lost = graph.resolve_spellings(links, notes)
    got = {r.src.removeprefix("from "): r.dst for r in met.collect()}
    assert got | {r.target: None for r in lost.collect()} == asked
