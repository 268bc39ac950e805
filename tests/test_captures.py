"""Capture logs by bytes: splitting, the source with its offsets, chunks, cursors and staged commits."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomstead.streaming import captures as C
from loomstead.streaming.commit import STEPS, Store

ODD = [b"a", b"word ", b"\n", "é".encode(), "漢".encode(), "😀".encode(), b"\xff", b"\xc3", b"\xe6\xbc", b"## not a header\n", b"\r\n"]


def odd(rng, n):
    return b"".join(rng.choice(ODD) for _ in range(n))


def test_split_points():
    rng = random.Random(1)
    for _ in range(2000):
        data, budget = odd(rng, rng.randint(1, 40)), rng.randint(4, 60)
        found = list(C.pieces(data, budget))
        assert b"".join(found) == data and all(0 < C.decoded_size(p) <= budget for p in found)
        for a, b in zip(found, found[1:], strict=False):
            if b"\n" in (a + b)[:budget] and C.decoded_size(a + b[:1]) > budget and C.decoded_size((a + b)[:budget]) <= budget:
                assert a.endswith(b"\n")
    assert C.split_point(b"one\ntwo three", 9) == 4 and C.split_point("ééé".encode(), 5) == 4 and C.split_point(b"\xff\xff\xff", 5) == 1
    with pytest.raises(ValueError, match="four bytes"):
        list(C.pieces(b"abc", 3))


def test_split_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    got = C.split_texts(docs, 500).collect()
    for r in docs.collect():
        mine = sorted((x for x in got if x.doc_id == r.doc_id), key=lambda x: x.place)
        assert b"".join(bytes(x.piece) for x in mine) == (r.text or "").encode()
        assert [bytes(x.piece) for x in mine] == list(C.pieces((r.text or "").encode(), 500))
        assert all(x.start == sum(len(y.piece) for y in mine[: x.place]) for x in mine)


def log(rng, day, turns):
    out = odd(rng, 3).replace(b"##", b"-") if rng.random() < 0.3 else b""
    for k in range(turns):
        out += b"" if not out or out.endswith(b"\n") else b"\n"
        iso = f"{day}T{k % 24:02d}:00:00.000Z" if rng.random() < 0.8 else f"{day}Tzz{k}"
        out += f"## {iso} {rng.choice(['user', 'assistant', 'system'])}\n".encode() + odd(rng, rng.choice([0, 1, 5, 30, 300]))
    return out


def build(root, seed=3, projects=3):
    rng = random.Random(seed)
    for p in range(projects):
        folder = root / f"p{p}/raw"
        folder.mkdir(parents=True)
        for d in (1, 2, 4):
            (folder / f"2024-01-0{d}.md").write_bytes(log(rng, f"2024-01-0{d}", rng.randint(0, 30)))
        (folder / "notes.md").write_bytes(b"## 2024-01-01T00:00:00Z user\nno day")


def segments_of(data, first=0):
    """Headers found in the whole text at once."""
    found = [(m.start(), m[1].decode(), m[2].decode()) for m in C.HEADER.finditer(data[first:])]
    found = [(first + a, i, r) for a, i, r in found]
    if first < len(data) and (not found or found[0][0] > first):
        found.insert(0, (first, None, None))
    ends = [a for a, _, _ in found[1:]] + [len(data)]
    return [(a, e, i, r, data[a:e]) for (a, i, r), e in zip(found, ends, strict=True)]


def run(spark, root, tmp, **options):
    """All that is new since the last run."""
    sink = str(tmp / "sink")

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    C.read_captures(spark, str(root), **options).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted(((r.project, r.file, r.start, r.end, r.iso, r.role, bytes(r.content)) for r in spark.read.parquet(sink).collect()), key=str)


@pytest.mark.parametrize("range_bytes", [7, 100, 1 << 20])
def test_ranges_do_not_matter(tmp_path, range_bytes):
    build(tmp_path)
    reader = C.CaptureReader({"path": str(tmp_path), "rangeBytes": str(range_bytes)})
    got = sorted((x for p in reader.partitions({}, reader.latestOffset()) for x in reader.read(p)), key=lambda x: x[:3])
    want = []
    for p in range(3):
        for f in sorted(os.listdir(tmp_path / f"p{p}/raw")):
            if f != "notes.md":
                want += [(f"p{p}", f, *s) for s in segments_of((tmp_path / f"p{p}/raw/{f}").read_bytes())]
    assert got == sorted(want, key=lambda x: x[:3]) and len(want) > 60


def test_source_goes_on_where_it_stopped(spark, tmp_path):
    root = tmp_path / "vault"
    build(root, projects=2)
    first = run(spark, root, tmp_path)
    assert run(spark, root, tmp_path) == first  # nothing new, nothing again
    with (root / "p0/raw/2024-01-04.md").open("ab") as f:
        f.write(b"\n## 2024-01-04T23:00:00.000Z user\nmore")
    (root / "p1/raw/2024-01-05.md").write_bytes(b"## 2024-01-05T01:00:00.000Z assistant\nnext day")
    (root / "p9/raw").mkdir(parents=True)
    (root / "p9/raw/2024-01-05.md").write_bytes(b"no header at all")
    second = [x for x in run(spark, root, tmp_path) if x not in first]
    assert [(x[0], x[4], x[6]) for x in second if x[4] or x[0] == "p9"] == [
        ("p0", "2024-01-04T23:00:00.000Z", b"## 2024-01-04T23:00:00.000Z user\nmore"), ("p1", "2024-01-05T01:00:00.000Z", b"## 2024-01-05T01:00:00.000Z assistant\nnext day"),
        ("p9", None, b"no header at all"),
    ]
    whole = (root / "p0/raw/2024-01-04.md").read_bytes()
    assert b"".join(x[6] for x in sorted(run(spark, root, tmp_path), key=lambda x: x[2]) if x[:2] == ("p0", "2024-01-04.md")) == whole


def test_truncated_files_are_refused(spark, tmp_path):
    (tmp_path / "p/raw").mkdir(parents=True)
    file = tmp_path / "p/raw/2024-01-01.md"
    file.write_bytes(b"## 2024-01-01T00:00:00Z user\nhello\n" * 3)
    reader = C.CaptureReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    file.write_bytes(b"## short")
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions({}, end)
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, C.CaptureReader({"path": str(tmp_path)}).latestOffset())
    lenient = C.CaptureReader({"path": str(tmp_path), "failOnDataLoss": "false"})
    assert [x[-1] for p in lenient.partitions({}, end) for x in lenient.read(p)] == [b"## short"]
    # A batch that is run again reads what it was told, though more has come since.
    file.write_bytes(b"## 2024-01-01T00:00:00Z user\nhello\n" * 9)
    assert len([x for p in reader.partitions({}, end) for x in reader.read(p)]) == 3


def chunk_one_by_one(segments, budget, floor):
    """The same by whole texts, following the rules word for word."""
    out, carry, most = [], None, None
    pending = [list(x) for x in segments]  # file, start, iso, data
    while pending:
        chunk, size, at = [], 0, 0
        while pending:
            file, start, iso, data = pending[0]
            real = C.valid_iso(iso)
            time = real or carry or f"{file[:10]}T00:00:00.000Z"
            n = C.decoded_size(data)
            if size + n <= budget:
                chunk.append((file, start, start + len(data), time, iso is not None, False, data))
                size, carry = size + n, real or carry
                most = max(most or time, time)
                pending.pop(0)
                continue
            left = budget - size
            if (not chunk or size < floor) and left > 0 and (at := C.split_point(data, left)):
                chunk.append((file, start, start + at, time, iso is not None, True, data[:at]))
                most = max(most or time, time)
                pending[0] = [file, start + at, None, data[at:]]
            break
        carry = most
        out.append(chunk)
    return out


@pytest.mark.parametrize("budget, floor", [(60, 20), (400, 100), (200_000, 500)])
def test_chunks(spark, tmp_path, budget, floor):
    build(tmp_path, seed=8)
    reader = C.CaptureReader({"path": str(tmp_path), "rangeBytes": "64"})
    rows = [x for p in reader.partitions({}, reader.latestOffset()) for x in reader.read(p)]
    random.Random(0).shuffle(rows)
    parts = C.chunked(spark.createDataFrame(rows, C.SEGMENT), budget=budget, floor=floor)
    got = {}
    for r in parts.collect():
        got.setdefault((r.project, r.chunk), []).append((r.file, r.start, r.end, r.iso, r.header, r.split, bytes(r.content)))
    want = {}
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: r[1:3])
        for k, chunk in enumerate(chunk_one_by_one([(r[1], r[2], r[4], r[6]) for r in mine], budget, floor)):
            want[p, k] = chunk
    assert {k: sorted(v, key=lambda x: x[:2]) for k, v in got.items()} == want
    assert all(sum(C.decoded_size(x[-1]) for x in c) <= budget for c in want.values())
    told = {(r.project, r.chunk): r for r in C.chunks(parts).collect()}
    for k, c in want.items():
        assert told[k].turns == sum(x[4] for x in c) and told[k].bytes == sum(len(x[-1]) for x in c) and told[k].boundary == ("split" if c[-1][5] else "turn")
        assert tuple(told[k].begin) == c[0][:2] and tuple(told[k].finish) == (c[-1][0], c[-1][2])
    marks = sorted((r.project, r.chunk, r.watermark) for r in C.watermarks(parts).collect())
    assert all(a[0] != b[0] or a[2] <= b[2] for a, b in zip(marks, marks[1:], strict=False))


def test_cursors(spark, tmp_path):
    good = b"## 2024-01-02T00:00:00Z user\nhello\n"
    for p in ("fine", "end", "split", "beyond", "inside", "gone", "future", "grown", "shape", "name", "neg"):
        (tmp_path / f"{p}/raw").mkdir(parents=True)
        for day in ("01", "02", "03"):
            f = tmp_path / f"{p}/raw/2024-01-{day}.md"
            f.write_bytes(good * 2)
            os.utime(f, (1_700_000_000, 1_700_000_000))
    os.remove(tmp_path / "gone/raw/2024-01-02.md")
    os.utime(tmp_path / "grown/raw/2024-01-01.md", (1_800_000_000, 1_800_000_000))
    n, row = len(good), lambda p, **k: {"project": p, "schema_version": 1, "file": "2024-01-02.md", "offset": len(good), "boundary": "turn", "last_turn_iso": None, "updated_at": None} | k
    rows = [
        row("fine"), row("end", offset=2 * n), row("split", offset=n + 3, boundary="split"), row("beyond", offset=2 * n + 1), row("inside", offset=n + 3), row("gone"),
        row("future", file="2030-01-01.md"), row("grown"), row("shape", schema_version=2), row("name", file="../x.md"), row("neg", offset=-1), row("nowhere"),
    ]
    cursors = spark.createDataFrame(rows, C.CURSOR).withColumn("updated_at", F.lit("2024-02-01").cast("timestamp"))
    got = {r.project: (r.file, r.offset, r.reason) for r in C.check_cursors(cursors, C.day_files(spark, str(tmp_path)), str(tmp_path), "2024-06-01").collect()}
    assert got == {
        "fine": ("2024-01-02.md", n, None), "end": ("2024-01-02.md", 2 * n, None), "split": ("2024-01-02.md", n + 3, None), "beyond": ("2024-01-02.md", 2 * n + 1, "offset_exceeds_size"),
        "inside": ("2024-01-02.md", n + 3, "boundary_misaligned"), "gone": ("2024-01-03.md", 0, None), "future": ("2030-01-01.md", 0, "future_dated_file"),
        "grown": ("2024-01-02.md", n, "below_cursor_growth"), "shape": ("2024-01-02.md", n, "schema_version"), "name": ("../x.md", n, "file"), "neg": ("2024-01-02.md", -1, "offset"),
        "nowhere": ("2024-01-02.md", 0, None),
    }
    told = spark.createDataFrame([("grown", "2024-01-02", "2024-01-05T03:00:00Z"), ("beyond", "2024-01-02", None)], "project string, day string, covers_until string")
    again = {r.project: r.file for r in C.begin_again(spark.createDataFrame([("grown",), ("beyond",), ("inside",), ("none",)], "project string"), told, C.day_files(spark, str(tmp_path))).collect()}
    assert again == {"grown": "2024-01-03.md", "beyond": "2024-01-02.md", "inside": "2024-01-01.md", "none": "0000-00-00.md"}


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("where", [0, 1])
def test_commits_after_a_crash(spark, tmp_path, step, where):
    store = Store(spark, f"file://{tmp_path}")

    def stop(at):
        if at == step:
            raise Crash

    for k in (0, 1):
        rows = spark.range(10 * k, 10 * k + 10)
        if k == where:
            with pytest.raises(Crash):
                store.commit(rows, k, {"p": k}, stop)
            assert store.cursors() == ({"p": k} if step in ("rename", "cursors", "clean") else {"p": 0} if k else {})
        store.commit(rows, k, {"p": k})
        store.commit(rows.union(rows), k, {"p": 99})  # a batch in its place stays as it is
    assert sorted(r.id for r in store.rows().collect()) == list(range(20)) and store.cursors() == {"p": 1}
    assert json.loads((tmp_path / "cursors.json").read_text())["batch"] == 1 and not (tmp_path / "tmp/batch=1").exists()


def test_queries(spark):
    """The chunk and split queries against the plain loop, on whole tables."""
    import hashlib

    from loomstead import catalog
    from loomstead.plans import streams
    from loomstead.plans.tables import derived

    sf, md5 = "/root/testdata/sf0.001", lambda b: hashlib.md5(b).hexdigest()
    rows = sorted((r.project, r.file, r.start, r.iso, bytes(r.content)) for r in streams._log(derived(spark, sf, "turns")).collect())
    want, text = set(), {}
    for p in {r[0] for r in rows}:
        for k, chunk in enumerate(chunk_one_by_one([r[1:] for r in rows if r[0] == p], 4096, C.FLOOR_BYTES)):
            want |= {(p, k, *x[:-1], md5(x[-1])) for x in chunk}
            text[p, k] = (max(x[3] for x in chunk), hashlib.sha256(b"".join(x[-1] for x in chunk)).hexdigest())
    query = catalog.queries()
    assert {tuple(r) for r in query["w08_byte_chunks"](spark, sf).collect()} == want
    assert {(r.project, r.chunk): (r.covers_until, r.digest) for r in query["st3_chunks"](spark, sf).collect()} == text
    marks = {(r.project, r.chunk): r.watermark for r in query["st4_watermarks"](spark, sf).collect()}
    assert all(m == max(v[0] for (p, c), v in text.items() if p == k[0] and c <= k[1]) for k, m in marks.items()) and marks.keys() == text.keys()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(tuple(r) for r in query["f46_split_points"](spark, sf).collect())
    assert [(d, k, md5(x)) for d in sorted(docs) for k, x in enumerate(C.pieces(docs[d], 4096))] == [(r[0], r[1], r[4]) for r in got]
