"""Batches committed in steps, so that one that stopped anywhere is run again to the same result.

Order of a batch: rows into a temporary folder, a manifest beside them, one
rename to their place, the cursors replaced, the temporary folder gone.
Readers look at places with a manifest only.  What a step has done is seen
by the next run: a batch in its place is not written again, and cursors are
replaced by those of its manifest.  Files go through Hadoop's file systems, so
any store with an atomic rename of a folder serves.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STEPS = ("rows", "manifest", "rename", "cursors", "clean")


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """Through a file beside it and a rename: never seen in parts."""
        beside = self.path(f"{name}.new")
        out = self.fs.create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.fs.delete(self.path(name), False)
        self.fs.rename(beside, self.path(name))

    def batch(self, batch_id: int) -> str:
        return f"batches/batch={batch_id}"

    def commit(self, rows: DataFrame, batch_id: int, cursors: dict, after: Callable[[str], None] = lambda step: None) -> None:
        """Write ``rows`` and ``cursors`` as batch ``batch_id``; ``after`` hears of each step that is done."""
        place, beside = self.batch(batch_id), f"tmp/batch={batch_id}"
        if not self.exists(f"{place}/_manifest.json"):
            rows.write.mode("overwrite").parquet(f"{self.root}/{beside}")
            after("rows")
            self.write(f"{beside}/_manifest.json", {"batch": batch_id, "cursors": cursors})
            after("manifest")
            self.fs.mkdirs(self.path("batches"))
            self.fs.delete(self.path(place), True)
            self.fs.rename(self.path(beside), self.path(place))
            after("rename")
        told = self.read(f"{place}/_manifest.json")
        if not self.exists("cursors.json") or self.read("cursors.json")["batch"] <= batch_id:
            self.write("cursors.json", told)
        after("cursors")
        self.fs.delete(self.path(beside), True)
        after("clean")

    def cursors(self) -> dict:
        """Those of the last batch in place; a batch whose rename was the last thing done counts."""
        known = self.read("cursors.json") if self.exists("cursors.json") else {"batch": -1, "cursors": {}}
        while self.exists(f"{self.batch(known['batch'] + 1)}/_manifest.json"):
            known = self.read(f"{self.batch(known['batch'] + 1)}/_manifest.json")
        return known["cursors"]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/batches")
