"""A vault of markdown documents with front matter, and JSON-lines dumps."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from loomstead.functions.text import body, front_matter

EXTERNAL_TAG = r"(?i)</?external-summary"  # fixed value: what wrapped text may not hold


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """One row a markdown file below ``path``: place, stem, time, size, front matter, body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("doc_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"),
        front_matter(text).alias("front_matter"), body(text).alias("body"),
    )


def find_document(vault: DataFrame, doc_id: str) -> DataFrame:
    """The document of an id; of several, the one whose path is least."""
    return vault.where(F.col("doc_id") == doc_id).orderBy("path").limit(1)


def recent(vault: DataFrame, limit: int = 10) -> DataFrame:
    return vault.orderBy(F.col("modified").desc(), "path").limit(limit)


def render(front: Column, text: Column) -> Column:
    """Front matter (a map; ``source`` is native if missing) and body as one markdown text."""
    whole = F.when(F.map_contains_key(front, "source"), front).otherwise(F.map_concat(front, F.create_map(F.lit("source"), F.lit("native"))))
    lines = F.transform(F.array_sort(F.map_entries(whole)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), text)


def wrap_external(source: Column, text: Column) -> Column:
    """Text of another system inside a tag; NUL bytes or the tag itself are an error."""
    bad = text.contains("\x00") | text.rlike(EXTERNAL_TAG)
    wrapped = F.concat(F.lit("<external-summary source=\""), source, F.lit("\">\n"), text, F.lit("\n</external-summary>"))
    return F.when(bad, F.raise_error(F.lit("text can't be wrapped")).cast("string")).otherwise(wrapped)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``mem0_id`` or ``id`` and ``text`` or ``memory``; rows without either are an error."""
    rows = spark.read.schema("mem0_id string, id string, text string, memory string").json(path)
    key, text = F.coalesce("mem0_id", "id"), F.coalesce("text", "memory")
    need = lambda c, what: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"row without {what}")).cast("string"))
    return rows.select(need(key, "an id").alias("id"), need(text, "a text").alias("text"))


def inside(root: str, path: str) -> str:
    """``path`` below ``root``, or an error where it leads out of it or isn't a markdown file."""
    clean = posixpath.normpath(path)
    if clean.startswith(("/", "..")) or "\x00" in path or not clean.endswith(".md"):
        raise ValueError(f"{path!r} is no markdown file below the vault")
    return f"{root.rstrip('/')}/{clean}"


class VaultWriter(DataSourceWriter):
    """Each document goes to a file beside its place and is moved there whole; a task that runs again does the same again."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.root) if "://" in self.root else (pyarrow.fs.LocalFileSystem(), self.root)
        for row in rows:
            place = inside(base, row.path)
            fs.create_dir(posixpath.dirname(place), recursive=True)
            beside = f"{place}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(beside) as out:
                out.write((row.text or "").encode())
            fs.move(beside, place)
        return WriterCommitMessage()


class VaultSink(DataSource):
    """``df.write.format("vault").mode("append").save(root)`` for rows of ``path`` (below the root) and ``text``."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.options["path"])


def write_vault(docs: DataFrame, root: str) -> None:
    """Write (``path``, ``text``) documents; one that is there is replaced, others stay."""
    docs.sparkSession.dataSource.register(VaultSink)
    docs.select("path", "text").write.format("vault").mode("append").save(root)
