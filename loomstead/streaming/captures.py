"""Capture logs (``<root>/<project>/raw/YYYY-MM-DD.md``) as a stream with byte offsets, checked cursors, and chunks.

The source reads new bytes of every project's day files, by ranges that are
cut at turn headers, so that neither a file nor a day is held whole.  A cursor
says that all files before its file and all bytes before its offset are read;
cursors are checked against what lies there before they are trusted.

Defined results: bytes need not be UTF-8 and come out as they are; text before
the first header of what is new belongs to the turn before and has no time of
its own; a header whose time can't be read begins a turn without one; names
that are no day are ignored; a missing root, or a project without files, is empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SEGMENT = "project string, file string, start bigint, end bigint, iso string, role string, content binary"
PIECE = "project string, chunk bigint, file string, start bigint, end bigint, iso string, header boolean, split boolean, content binary"
CURSOR = "project string, schema_version int, file string, offset bigint, boundary string, last_turn_iso string, updated_at timestamp"
HEADER = re.compile(rb"^## (\d{4}-\d{2}-\d{2}T\S*) (user|assistant|system)\b", re.M)
DAY_FILE = r"^\d{4}-\d{2}-\d{2}\.md$"
CHUNK_BYTES, FLOOR_BYTES, SLACK_HOURS = 200_000, 500, 48  # fixed values
RANGE_BYTES, STEP, LINE = 8 << 20, 1 << 18, 256


# ---- Splitting by bytes -------------------------------------------------------


def decoded_size(data: bytes) -> int:
    """Bytes of the text that ``data`` is read as; each invalid sequence becomes three."""
    return len(data.decode("utf-8", "replace").encode())


def _boundary(data: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split_point(data: bytes, budget: int) -> int:
    """Where to cut so that what comes before takes at most ``budget`` bytes as text: after the last line end
    within it, else before a character."""
    limit = min(budget, len(data))
    line = data.rfind(b"\n", 0, limit)
    at = line + 1 if line >= 0 else _boundary(data, limit)
    while at > 0 and decoded_size(data[:at]) > budget:
        at = _boundary(data, at - 1)
    return at


def pieces(data: bytes, budget: int) -> Iterator[bytes]:
    """``data`` in pieces of at most ``budget`` bytes as text; a budget below four bytes is refused, since a character may need them."""
    if budget < 4:
        raise ValueError("a piece needs four bytes at least")
    view = memoryview(data)
    at = 0
    while at < len(data):
        window = bytes(view[at : at + budget + 1])
        here = len(window) if len(window) <= budget and decoded_size(window) <= budget else split_point(window, budget)
        yield window[:here]
        at += here


def split_texts(docs: DataFrame, budget: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``place``, ``start`` and ``piece`` of each document's text (null: none), in pieces of at most ``budget`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                found = list(pieces(text.as_py() or b"", budget))
                starts = [0]
                for p in found:
                    starts.append(starts[-1] + len(p))
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * n, batch.schema.field(0).type), pa.array(range(n), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(found, pa.binary())],
                    ["doc_id", "place", "start", "piece"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, place bigint, start bigint, piece binary")


# ---- The source ---------------------------------------------------------------


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _listed(root: str) -> dict[str, dict[str, int]]:
    """Size of each day file by project."""
    fs, base = file_system(root)
    found: dict[str, dict[str, int]] = {}
    for info in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = info.path[len(base) :].strip("/").split("/")
        if info.is_file and len(parts) == 3 and parts[1] == "raw" and re.match(DAY_FILE, parts[2]):
            found.setdefault(parts[0], {})[parts[2]] = info.size
    return found


class Range(InputPartition):
    """Bytes ``begin`` to ``stop`` of a file; ``first`` and ``last`` are the ends of what is read of it."""

    def __init__(self, project: str, file: str, begin: int, stop: int, first: int, last: int) -> None:
        self.project, self.file, self.begin, self.stop, self.first, self.last = project, file, begin, stop, first, last


def _read(handle, start: int, end: int) -> bytes:
    handle.seek(start)
    return handle.read(max(0, end - start))


def _headers(handle, begin: int, first: int, last: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Place, time and role of the headers from ``begin`` on, by steps; a header's line is at most ``LINE`` bytes long."""
    for at in range(begin, last, STEP):
        low = max(first, at - 1)  # a line begins after the byte before
        for m in HEADER.finditer(_read(handle, low, min(last, at + STEP + LINE))):
            if at <= low + m.start() < at + STEP:
                yield low + m.start(), m[1], m[2]


def _turns(handle, part: Range) -> Iterator[tuple[int, bytes | None, bytes | None, bytes]]:
    """Start, time, role and bytes of the turns that begin in a range; what comes before the first header begins at ``first``.

    A turn longer than ``CHUNK_BYTES`` comes out in pieces, cut from its own start, so that ranges don't matter.
    """
    heads = _headers(handle, part.begin, part.first, part.last)
    turn = next(heads, None)
    after = turn if part.begin == part.first and (turn is None or turn[0] > part.first) else next(heads, None)
    turn = (part.first, None, None) if part.begin == part.first and (turn is None or turn[0] > part.first) else turn
    while turn and turn[0] < part.stop:
        at, iso, role = turn
        end = after[0] if after else part.last
        while at < end:
            data = _read(handle, at, min(end, at + CHUNK_BYTES + 1))
            cut = len(data) if len(data) <= CHUNK_BYTES else split_point(data, CHUNK_BYTES)
            yield at, iso, role, data[:cut]
            at, iso, role = at + cut, None, None
        turn, after = after, next(heads, None)


class CaptureReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.lose = options.get("failOnDataLoss", "true").lower() == "false"
        self.begin = json.loads(options.get("cursors", "{}"))
        self.last: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {p: {"file": c["file"], "offset": c["offset"], "closed": {}} for p, c in self.begin.items()}

    def latestOffset(self) -> dict:
        """Per project its newest file and size, and the sizes of files closed since the offset told before, so that a batch that
        is run again reads the same bytes."""
        now = {}
        for project, files in _listed(self.root).items():
            newest = max(files)
            since = self.last.get(project, "")
            now[project] = {"file": newest, "offset": files[newest], "closed": {f: n for f, n in files.items() if since <= f < newest}}
        self.last = {p: o["file"] for p, o in now.items()}
        return now

    def partitions(self, start: dict, end: dict) -> list[Range]:
        there = _listed(self.root)
        out: list[Range] = []
        for project, to in sorted(end.items()):
            came = start.get(project, {"file": "", "offset": 0})
            sizes = {**to["closed"], to["file"]: to["offset"]}
            for file in sorted(f for f in sizes if f >= came["file"]):
                first, last = came["offset"] if file == came["file"] else 0, sizes[file]
                real = there.get(project, {}).get(file)
                if real is None or real < max(first, last) or last < first:
                    if first == last or real is None and not self.lose and file != came["file"]:
                        continue
                    if not self.lose:
                        raise ValueError(f"{project}/{file} is shorter than what was told of it; check cursors, or set failOnDataLoss to false")
                    last = min(last, real or 0)
                cuts = [*range(first, last, self.range_bytes), last]
                out += [Range(project, file, a, b, first, last) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, base = file_system(self.root)
        text = lambda b: b.decode("ascii", "replace") if b is not None else None
        with fs.open_input_file(f"{base}/{partition.project}/raw/{partition.file}") as handle:
            for at, iso, role, data in _turns(handle, partition):
                yield partition.project, partition.file, at, at + len(data), text(iso), text(role), data


class CaptureSource(DataSource):
    """``spark.readStream.format("captures").load(root)``; options ``rangeBytes``, ``cursors`` (JSON, by project) and ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SEGMENT

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def read_captures(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").options(**options).load(root)


# ---- Chunks -------------------------------------------------------------------


def valid_iso(iso: str | None) -> str | None:
    """The time in a fixed form, or null where it is none."""
    try:
        at = datetime.fromisoformat(iso.replace("Z", "+00:00")) if iso else None
    except ValueError:
        return None
    return iso if at else None


class Chunker:
    """Segments of a project in order become chunks of whole turns; a chunk below ``floor`` is filled by part of the next turn."""

    def __init__(self, budget: int, floor: int) -> None:
        self.budget, self.floor = budget, floor
        self.chunk, self.held, self.some = 0, 0, False
        self.carry: str | None = None
        self.most: str | None = None

    def _end(self) -> None:
        self.chunk, self.held, self.some = self.chunk + 1, 0, False
        self.carry = self.most

    def add(self, file: str, start: int, iso: str | None, data: bytes) -> Iterator[tuple]:
        """Pieces (chunk, file, start, end, time, begins a turn, was split, bytes)."""
        header = iso is not None
        while data:
            real = valid_iso(iso) if header else None
            at = real or self.carry or f"{file[:10]}T00:00:00.000Z"
            size = decoded_size(data)
            if self.held + size > self.budget:
                left = self.budget - self.held
                cut = split_point(data[: left + 1], left) if (not self.some or self.held < self.floor) and left > 0 else 0
                if not cut and not self.some:
                    cut = max(1, _boundary(data, min(len(data), self.budget)))
                if cut:
                    self.most = max(self.most or at, at)
                    yield self.chunk, file, start, start + cut, at, header, True, data[:cut]
                    start, data, header, iso = start + cut, data[cut:], False, None
                self._end()
                continue
            if real:
                self.carry = real
            self.most = max(self.most or at, at)
            self.held, self.some = self.held + size, True
            yield self.chunk, file, start, start + len(data), at, header, False, data
            return


def chunked(segments: DataFrame, *, budget: int = CHUNK_BYTES, floor: int = FLOOR_BYTES) -> DataFrame:
    """Pieces of chunks, in order within each project.

    Projects are folded one after another in sorted partitions, batch by batch;
    what is held is a chunk's sums, never its bytes or a day.
    """
    if budget < 4:
        raise ValueError("a chunk needs four bytes at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, state = object(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["project"] != project:
                    project, state = r["project"], Chunker(budget, floor)
                out += [(project, *x) for x in state.add(r["file"], r["start"], r["iso"], r["content"])]
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
            names = ["project", "chunk", "file", "start", "end", "iso", "header", "split", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = segments.select("project", "file", "start", "iso", "content").repartition("project").sortWithinPartitions("project", "file", "start")
    return rows.mapInArrow(run, PIECE)


def chunks(parts: DataFrame) -> DataFrame:
    """A row a chunk: its turns, size, text, the times it covers, where it begins and ends, and whether a turn was split there."""
    order = F.struct("file", "start")
    content = F.array_sort(F.collect_list(F.struct("file", "start", "content")))
    text = F.array_join(F.transform(content, lambda p: p["content"].cast("string")), "")
    return parts.groupBy("project", "chunk").agg(
        F.count_if("header").alias("turns"), F.sum(F.octet_length("content")).alias("bytes"), F.min("iso").alias("covers_from"), F.max("iso").alias("covers_until"),
        F.min(order).alias("begin"), F.max(F.struct("file", "end")).alias("finish"), F.when(F.max_by("split", order), "split").otherwise("turn").alias("boundary"), text.alias("text"),
    )


# ---- Cursors ------------------------------------------------------------------


def day_files(spark: SparkSession, root: str) -> DataFrame:
    """``project``, ``file``, ``size`` and ``modified`` of the day files, without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root).select("path", "length", "modificationTime")
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/raw/(\d{4}-\d{2}-\d{2}\.md)$", i)
    return found.select(part(1).alias("project"), part(2).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where("file <> ''")


def _heads(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        for batch in batches:
            got = []
            for r in batch.to_pylist():
                with fs.open_input_file(f"{base}/{r['project']}/raw/{r['file']}") as handle:
                    handle.seek(max(0, r["offset"] - 1))
                    data = handle.read(LINE)
                got.append(bool(HEADER.match(data) if not r["offset"] else data[:1] == b"\n" and HEADER.match(data[1:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.bool_())], ["project", "aligned"])

    return run


def check_cursors(cursors: DataFrame, files: DataFrame, root: str, today: str) -> DataFrame:
    """``project``, ``file``, ``offset``, ``boundary`` and ``reason`` of each cursor (one a project): a reason means that it can't be trusted.

    In this order: its shape; a file that is gone (the next one then, unless
    it lies ahead of ``today`` with none after it); an offset beyond the file;
    an offset that should begin a turn and doesn't; a file before it that has
    changed since.
    """
    shape = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "schema_version").when(~F.coalesce(F.col("file").rlike(DAY_FILE), F.lit(False)), "file")
        .when(F.col("offset").isNull() | (F.col("offset") < 0), "offset").when(~F.coalesce(F.col("boundary").isin("turn", "split"), F.lit(False)), "boundary")
    )
    c = cursors.select("*", shape.alias("shape"))
    mine = files.select("project", "file", F.col("size").alias("_size"))
    c = c.join(mine, ["project", "file"], "left")
    other = files.select("project", F.col("file").alias("_file"), "modified")
    near = c.join(other, "project").groupBy("project").agg(
        F.min(F.when(F.col("_file") > F.col("file"), F.col("_file"))).alias("next"), F.max((F.col("_file") < F.col("file")) & (F.col("modified") > F.col("updated_at"))).alias("grown"),
    )
    asked = c.where("shape IS NULL AND boundary = 'turn' AND offset < _size").select("project", "file", "offset")
    heads = asked.mapInArrow(_heads(root), "project string, aligned boolean")
    c = c.join(near, "project", "left").join(heads, "project", "left")
    gone, grown = F.col("_size").isNull(), F.coalesce("grown", F.lit(False))
    reason = (
        F.when(F.col("shape").isNotNull(), F.col("shape")).when(gone & grown, "below_cursor_growth").when(gone & F.col("next").isNull() & (F.col("file") > f"{today}.md"), "future_dated_file")
        .when(F.col("offset") > F.col("_size"), "offset_exceeds_size").when(~F.coalesce("aligned", F.lit(True)), "boundary_misaligned").when(grown, "below_cursor_growth")
    )
    moved = F.col("shape").isNull() & gone
    return c.select(
        "project", F.when(moved, F.coalesce("next", "file")).otherwise(F.col("file")).alias("file"), F.when(moved, 0).otherwise(F.col("offset")).alias("offset"),
        F.when(moved, "turn").otherwise(F.col("boundary")).alias("boundary"), reason.alias("reason"),
    )


def begin_again(projects: DataFrame, summaries: DataFrame, files: DataFrame) -> DataFrame:
    """A cursor for each of ``projects`` without a trusted one: two days before what its newest summary covers, else at that summary's
    day, else at its oldest file, else before all days.  ``summaries`` have project, day and covers_until (or null)."""
    latest = summaries.groupBy("project").agg(F.max(F.try_to_timestamp("covers_until")).alias("until"), F.max("day").alias("day"))
    oldest = files.groupBy("project").agg(F.min("file").alias("oldest"))
    back = F.date_format(F.col("until") - F.expr(f"INTERVAL {SLACK_HOURS} HOURS"), "yyyy-MM-dd")
    file = F.coalesce(F.concat(back, F.lit(".md")), F.concat("day", F.lit(".md")), "oldest", F.lit("0000-00-00.md"))
    return projects.select("project").distinct().join(latest, "project", "left").join(oldest, "project", "left").select("project", file.alias("file"), F.lit(0).cast("bigint").alias("offset"), F.lit("turn").alias("boundary"))


def watermarks(parts: DataFrame) -> DataFrame:
    """The latest time told so far after each chunk; it never goes back (a row a chunk)."""
    each = parts.groupBy("project", "chunk").agg(F.max("iso").alias("until"))
    return each.withColumn("watermark", F.max("until").over(Window.partitionBy("project").orderBy("chunk")))
