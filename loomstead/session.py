"""Session helpers: the shared scratch folder and materialised intermediates."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TABLES = "loomstead_scratch_"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a temporary folder is chosen once per session
    and set as the checkpoint folder; that serves tests on one machine only,
    so a session on a cluster without the setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("loomstead.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstead-")
        spark.conf.set("loomstead.scratch.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    Unlike a local checkpoint, the files outlive executors, and the plan that
    follows starts from them.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_buckets(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: joins on it don't shuffle these rows again."""
    path = shared_dir(df.sparkSession)
    name = _TABLES + path.rpartition("/")[2]
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_tables(spark: SparkSession) -> None:
    """Forget the tables of ``written_buckets``; for the end of a job. Files go with the shared folder."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_TABLES):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once, so that their Python workers can import it."""
    sc = spark.sparkContext
    name = Path(__file__).parent.name
    if not any(x.rpartition("/")[2] == f"{name}.zip" for x in sc.listFiles):
        folder = tempfile.mkdtemp(prefix=f"{name}-")
        packed = shutil.make_archive(f"{folder}/{name}", "zip", Path(__file__).parent.parent, name)
        sc.addPyFile(packed)
    return spark
