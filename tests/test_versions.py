"""Versions of an index: swaps that are refused, readers that stay, files that are skipped."""

import pytest
from pyspark.sql import functions as F

from loomstead.plans.tables import derived
from loomstead.sources.versions import Index, Refused, lookup, rows_scanned

STAMP = {"provider": "local", "model": "m1", "dimension": 64}


def test_swaps(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}")
    assert index.version() == 0
    first = index.stage(spark.range(100))
    assert index.swap(first, STAMP, 100, 0) == 1
    reader = index.read()
    second = index.stage(spark.range(150))
    for stamp, rows, expected, why in ((None, 150, 1, "stamp"), ({**STAMP, "model": ""}, 150, 1, "stamp"), (STAMP, 149, 1, "149"), (STAMP, 150, 0, "version 1")):
        with pytest.raises(Refused, match=why):
            index.swap(second, stamp, rows, expected)
        assert index.version() == 1 and index.read().count() == 100
    assert index.swap(second, STAMP, 150, 1) == 2
    assert index.read().count() == 150 and reader.count() == 100 and index.read(1).count() == 100
    assert index.verify(STAMP) == {"stamp": True, "rows": True} and index.verify({**STAMP, "model": "m2"}) == {"stamp": False, "rows": True}


def test_two_writers(spark, tmp_path, monkeypatch):
    index, other = Index(spark, f"file://{tmp_path}"), Index(spark, f"file://{tmp_path}")
    index.swap(index.stage(spark.range(5)), STAMP, 5, 0)
    late = other.stage(spark.range(7))
    monkeypatch.setattr(other, "version", lambda: 1)  # it looked before the first was done
    index.swap(index.stage(spark.range(6)), STAMP, 6, 1)
    with pytest.raises(Refused, match="another writer"):
        other.swap(late, STAMP, 7, 1)
    assert index.read().count() == 6


def test_lookups_skip(spark, tmp_path):
    points = derived(spark, "/root/testdata/sf0.01", "points").select("seq", "user_id", "lane", "persona", F.md5(F.col("seq").cast("string")).alias("hash"))
    index = Index(spark, f"file://{tmp_path}")
    index.swap(index.stage(points, by=("lane", "persona"), looked_up=("hash",), files=16), STAMP, points.count(), 0)
    wanted = [points.first().hash]
    found = lookup(index.read(), wanted)
    assert [r.hash for r in found.collect()] == wanted
    assert rows_scanned(lookup(index.read(), wanted)) <= points.count() / 3
    lane = index.read().where("lane = 'lane1'")
    assert lane.count() == points.where("lane = 'lane1'").count() and rows_scanned(lane) < points.count() * 0.7
    assert lookup(index.read(), ["no such hash"]).collect() == []
