"""An index in versions: a rebuilt one is taken over by one step that succeeds or leaves all as it was.

A version is a folder of Parquet files; ``versions/<n>.json`` names it with its
rows and the stamp of its vectors.  The next number is taken by creating its
file, which fails if another writer was first (compare and swap).  Readers
resolve the highest number once and stay on that folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(Exception):
    """A swap that was not made; nothing has changed."""


class Index:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest version, 0 where there is none."""
        if not self.fs.exists(self.path("versions")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self.path(f"versions/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def stage(self, rows: DataFrame, *, by: tuple[str, ...] = (), looked_up: tuple[str, ...] = (), files: int | None = None) -> str:
        """A folder with ``rows``, sorted by the columns ``by`` and with Bloom filters on ``looked_up``, that no reader sees yet.

        ``files`` is their number; otherwise it follows from the rows' size.  Filters on the first skip files and row groups by their bounds, those on the others by the Bloom filters.
        """
        folder = f"data/{uuid.uuid4().hex}"
        if by or looked_up:
            rows = rows.repartitionByRange(*([files] if files else []), *by, *looked_up).sortWithinPartitions(*by, *looked_up)
        writer = rows.write
        for c in looked_up:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def swap(self, folder: str, stamp: dict | None, rows: int, expected: int) -> int:
        """Make ``folder`` the version after ``expected``; refused without a stamp, where the count differs from what lies
        there, or where another writer has been first."""
        if not stamp or not all(stamp.get(k) for k in ("provider", "model", "dimension")):
            raise Refused("the rebuilt index has no stamp of its vectors")
        found = self.spark.read.parquet(f"{self.root}/{folder}").count()
        if found != rows:
            raise Refused(f"the rebuilt index has {found} rows, not {rows}")
        if self.version() != expected:
            raise Refused(f"version {self.version()} is there, not {expected}")
        self.fs.mkdirs(self.path("versions"))
        try:
            out = self.fs.create(self.path(f"versions/{expected + 1}.json"), False)
        except Exception as e:
            raise Refused(f"another writer took version {expected + 1}") from e
        out.write(bytearray(json.dumps({"folder": folder, "stamp": stamp, "rows": rows}).encode()))
        out.close()
        return expected + 1

    def verify(self, stamp: dict) -> dict[str, bool]:
        """Whether the version that readers see has the stamp and the rows that it tells."""
        told = self.manifest(self.version())
        return {"stamp": told["stamp"] == stamp, "rows": self.read().count() == told["rows"]}

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest(self.version() if version is None else version)['folder']}")


def rows_scanned(df: DataFrame) -> int:
    """Rows that the scans of ``df`` gave after it ran, which is what was not skipped; runs it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def lookup(points: DataFrame, hashes: list[str]) -> DataFrame:
    return points.where(F.col("hash").isin(hashes))
