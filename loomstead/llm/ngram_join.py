"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct 3-word shingles; documents whose sets have
a Jaccard similarity of at least ``threshold`` are linked, and linked
documents form components.

1. Sets that are equal are one entity (its signature stands for it).
2. Every shingle's frequency is estimated over all documents by a table of
   2 ** SKETCH_BITS hashed counters.  Any fixed order of shingles is valid for
   prefix filtering; this one puts rare shingles first.
3. A pair that is similar enough shares at least k shingles among the first
   n - ceil(t n) + k of each.  Rare shingles of the prefix (k = 1) are indexed
   alone.  For frequent ones, short sets extend the prefix to k = 2 and index
   pairs of frequent shingles; sets longer than ``COMBINE_UP_TO`` index them
   alone, and sets whose partners may lie on the other side do both.
4. A key shared by few sets gives all its pairs.  A key shared by many first
   gives the pairs with its pivot, its least signature, so that keys with the
   same sets give the same pairs.  Sets in their pivot's component need no more
   comparisons with others in it; the rest are compared with that component and
   with each other, block by block within tasks, first by bitmaps, then the sets
   that these leave possible by their whole sets.  A task tells no more than
   which of its sets are possible, and links enough to join those that have one;
   no list of all pairs is made.  Where there are several blocks, each set meets
   one first, so that few are left for all the others.  A signature's last byte tells its set's size
   in steps of a sixteenth of a doubling, so sets that are too unlike in size
   make no pair.
5. Two sets whose parity bitmaps (one bit flipped for each shingle, by hash; as
   many bits as shingles or more) differ in more bits than their symmetric
   difference may have are dropped; the other candidates are verified on the
   whole sets; links are contracted.
6. Where numbers of links are asked for, they are counted within components,
   block by block; no list of all pairs is made.

Shingles are compared by 64-bit hashes, whole sets by 56 bits of them; sets are
equal where 56 bits of a hash of the set and the size's byte are.

Defined results: texts without words (null, empty, white space) have an empty
set and are components of their own; fewer than 3 words are one shingle;
repeated rows are returned each, in one component; null ids are components of
their own by their set; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.components import connected_components
from loomstead.session import written, written_buckets

SKETCH_BITS = 20
CHUNKS = 64
COMBINE_UP_TO = 200
ALL_PAIRS_UP_TO = 8
FREQUENT = 64
BLOCK = 2048
COUNTED = 2048
COUNTED_ITEMS = 1 << 20
SIEVE = 1 << 20
CACHE_WORDS = 100_000

_P1, _P2, _P3, _P4 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P4
    return x ^ (x >> np.uint64(29))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; each word is hashed once."""

    def __init__(self, width: int = 3) -> None:
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - self.width + 1
        x = np.zeros(n, np.uint64)
        for i in range(self.width):
            x = _mix(_turn(x, 23) * _P1 + h[i : i + n] * _P2 + _P3)
        return np.unique(x)


SIZE_STEPS = 16  # to a doubling of the size


def signature(shingles: np.ndarray) -> int:
    """56 bits of the set's hash, then a byte that tells its size; sizes of 62,758 and more share one."""
    size = min(255, int(SIZE_STEPS * math.log2(max(1, len(shingles)))))
    return (xxhash.xxh3_64_intdigest(shingles.tobytes()) & ~255 | size) - (1 << 63)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    """Whether the sizes that two signatures tell leave a link possible."""
    size = lambda s: F.col(s).bitwiseAND(F.lit(255))
    return F.abs(size(a) - size(b)) <= int(SIZE_STEPS * math.log2(100 / percent) + 1e-9) + 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


PARITY_BITS = 1 << 16  # at most


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap with the parity of the set's shingles in each of its places: a shingle in which two sets differ
    changes one bit, so bitmaps differ in at most as many bits as sets in shingles.

    There are at least as many places as shingles, else bitmaps of sets with nothing in common would differ in no more
    bits than those of linked ones.  Numbers of places are powers of two: parts laid upon one another give the fewer.
    """
    places = min(PARITY_BITS, max(64, 1 << (len(s) - 1).bit_length())) if len(s) else 64
    place = ((s >> np.uint64(40)) & np.uint64(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=places) & 1).astype(np.uint8)).view("<i8")


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) with so many 64-bit words."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


_SURVEY = "doc_id bigint, n int, sig bigint, bits array<bigint>, chunk int, counts binary"


def _survey(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A narrow row for each document, then this task's counters of shingles of its distinct sets."""
        shingles, seen = Shingler(width), set()
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)

        def narrow(held: list) -> pa.RecordBatch:
            ids, n, sigs, bits = zip(*held, strict=True)
            k = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(sigs, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "n", "sig", "bits", "chunk", "counts"],
            )

        held: list[tuple] = []
        for doc_id, text in _rows(batches):
            s = shingles(text)
            sig = signature(s)
            held.append((doc_id, len(s), sig, parity(s)))
            if len(s) and sig not in seen:
                seen.add(sig)
                counters += np.bincount((s & mask).astype(np.int64), minlength=len(counters)).astype(np.uint32) if len(s) > 50_000 else 0
                if len(s) <= 50_000:
                    np.add.at(counters, (s & mask).astype(np.int64), 1)
            if len(held) >= 4096:
                yield narrow(held)
                held = []
        if held:
            yield narrow(held)
        if seen:
            parts = counters.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int32()), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.list_(pa.int64())), pa.array(range(CHUNKS), pa.int32()),
                 pa.array([zlib.compress(p.astype("<u4").tobytes(), 1) for p in parts], pa.binary())],
                names=["doc_id", "n", "sig", "bits", "chunk", "counts"],
            )

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // CHUNKS, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), "<u4")
    code = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "code": pa.array([code.tobytes()], pa.binary()), "total": pa.array([int(total.sum())], pa.int64())})


def needed(n: int, percent: int) -> int:
    """Least overlap a set of ``n`` has with any set it is linked to."""
    return -(-n * percent // 100)


def prefix_keys(s: np.ndarray, code: np.ndarray, frequent: int, percent: int) -> np.ndarray:
    """Index keys of one set; ``code`` has each counter's rank by frequency."""
    n = len(s)
    rank = code[(s & np.uint64(len(code) - 1)).astype(np.int64)]
    order = np.lexsort((s, rank))
    spare = n - needed(n, percent)
    first, rare = order[: spare + 1], rank < frequent
    keys = [s[first[rare[first]]]]
    if 100 * n >= percent * COMBINE_UP_TO:  # a partner may be longer than COMBINE_UP_TO
        keys.append(s[first[~rare[first]]])
    if n <= COMBINE_UP_TO and n >= 2:
        often = order[: spare + 2]
        often = s[often[~rare[often]]]
        a, b = np.triu_indices(len(often), 1)
        keys.append(_mix(_turn(often[a], 31) * _P1 ^ often[b] * _P3))
    return np.concatenate(keys)


def _index(width: int, code: bytes, frequent: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, codes = Shingler(width), set(), np.frombuffer(code, np.uint8)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            k = [len(x) for x, _ in held]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x for x, _ in held]).view(np.int64)), pa.array(np.repeat([s for _, s in held], k), pa.int64())],
                names=["key", "sig"],
            )

        for _, text in _rows(batches):
            s = shingles(text)
            if len(s) < 2:
                continue
            sig = signature(s)
            if sig in seen:  # copies within a task are one set already
                continue
            seen.add(sig)
            held.append((prefix_keys(s, codes, frequent, percent), sig))
            size += len(held[-1][0])
            if size > 100_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def pack_set(s: np.ndarray) -> bytes:
    """A sorted set by the upper 56 bits of its hashes: differences by byte planes, compressed."""
    steps = np.diff(s >> np.uint64(8), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_set(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = [shingles(t) for t in batch.slice(at, 256).column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signature(s) for s in some], pa.int64()), pa.array([pack_set(s) for s in some], pa.binary())], names=["sig", "items"]
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        both = []
        for i in range(batch.num_rows):
            a, b = unpack_set(x[i].as_py()), unpack_set(y[i].as_py())
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both.append((len(a), len(b), int((b[at] == a).sum())))
        na, nb, o = (pa.array(v, pa.int64()) for v in zip(*both, strict=True)) if both else (pa.array([], pa.int64()),) * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), na, nb, o], names=["a", "b", "na", "nb", "o"])


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether bitmaps differ in no more bits than the sets of two linked documents of these sizes may."""
    x, y = F.col(f"bits{a}"), F.col(f"bits{b}")
    words = F.least(F.size(x), F.size(y))
    part = lambda bits, i: F.aggregate(F.sequence(i, F.size(bits) - 1, words), F.lit(0).cast("bigint"), lambda t, j: t.bitwiseXOR(F.get(bits, j)))
    folded = lambda bits: F.when(F.size(bits) == words, bits).otherwise(F.transform(F.sequence(F.lit(0), words - 1), lambda i: part(bits, i)))
    differ = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, p: t + p)
    size = F.col(f"n{a}") + F.col(f"n{b}")
    return differ <= size - 2 * F.ceil(size * percent / (100 + percent) - 1e-9)


def _close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes and bitmaps leave a link possible."""
    of = lambda s: reps.select(F.col("sig").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"))
    both = pairs.distinct().join(of("a"), "a").join(of("b"), "b")
    alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return written(both.where(alike & _may_link("a", "b", percent)).select("a", "b"))


class _Sets:
    """Whole sets of the signatures asked for so far; documents are read again only for new ones.

    Texts are sieved by a broadcast table of hashed ids before they are shuffled; it has ``SIEVE`` rows at most.
    """

    def __init__(self, base: DataFrame, reps: DataFrame, width: int) -> None:
        self.base, self.reps, self.width = base, reps, width
        self.parts: list[DataFrame] = []  # tables bucketed by signature: joins on it move the other side only

    def of(self, asked: DataFrame) -> DataFrame:
        """The sets of all signatures ``sig`` of ``asked``, and perhaps others."""
        asked = asked.select("sig").distinct()
        wanted = asked
        for part in self.parts:
            wanted = wanted.join(part.select("sig"), "sig", "left_anti")
        wanted = written(self.reps.join(wanted, "sig").select("sig", F.col("rep").alias("doc_id")))
        if not self.parts or wanted.limit(1).count():
            tag = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)).cast("int").alias("tag")
            sieved = self.base.select("*", tag).join(F.broadcast(wanted.select(tag).distinct()), "tag", "left_semi")
            texts = sieved.join(wanted.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
            sets = texts.mapInArrow(_sets(self.width), "sig bigint, items binary").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
            self.parts.append(written_buckets(sets, int(self.base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig"))
        if len(self.parts) == 1:
            return self.parts[0]
        asked = written(asked)
        return reduce(DataFrame.union, [part.join(asked, "sig", "left_semi") for part in self.parts])

    def linked(self, pairs: DataFrame, percent: int) -> DataFrame:
        """Those of the pairs that are links."""
        sets = self.of(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")))
        x, y = sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), sets.select(F.col("sig").alias("b"), F.col("items").alias("y"))
        met = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        checked = written(met.mapInArrow(_overlaps, "a bigint, b bigint, na bigint, nb bigint, o bigint"))
        return checked.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b")


def ngram_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, links: bool = False
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of ``docs``; with ``links`` also ``n_links``,
    the number of other rows it is linked to."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = written(base.mapInArrow(_survey(width), _SURVEY))
    narrow = survey.where("chunk IS NULL").select("doc_id", "n", "sig", "bits")
    chunks = survey.where("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(_summed, "chunk int, code binary, total bigint").collect()
    reps = narrow.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
    reps = written(reps)
    named = reps.select("sig", "rep", "n", "copies", F.col("sig").alias("node"))
    sets = _Sets(base, reps, width)
    if chunks:
        code = b"".join(bytes(r.code) for r in sorted(chunks, key=lambda r: r.chunk))
        mean = sum(r.total for r in chunks) / (1 << SKETCH_BITS)
        frequent = int(8 * np.log2(max(FREQUENT, 4 * mean) + 1))
        roots = connected_components(_links(base, reps, sets, width, percent, code, frequent), "a", "b")
        named = written(reps.join(roots, reps.sig == roots.node, "left").select("sig", "rep", "n", "copies", F.coalesce("component", "sig").alias("node")))
    least = named.groupBy("node").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "node").select("sig", "component_id", "copies")
    if links:
        classes = classes.join(_link_counts(named, sets, percent), "sig", "left")
    classed = narrow.drop("bits").join(classes, "sig", "left")
    own = (F.col("n") == 0) | F.col("component_id").isNull()
    out = [F.col("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")]
    if links:
        out.append((F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"))
    return classed.select(*out)


def _links(base: DataFrame, reps: DataFrame, sets: _Sets, width: int, percent: int, code: bytes, frequent: int) -> DataFrame:
    """Links that join all components; a class of linked sets is held together by links to its pivots."""
    index = written(base.mapInArrow(_index(width, code, frequent, percent), "key bigint, sig bigint"))
    groups = written(_shared(index))
    few, many = groups.where(F.col("m") <= ALL_PAIRS_UP_TO), groups.where(F.col("m") > ALL_PAIRS_UP_TO)
    stars = written(many.where("pivot < sig").select("pivot", "sig").distinct())
    near = stars.select(F.col("pivot").alias("a"), F.col("sig").alias("b")).where(_near_sizes("a", "b", percent))
    links = sets.linked(_close(_met(few, percent).union(near), reps, percent), percent)
    held, sizes = _unsettled(stars, links, reps)
    if sizes.where("m > 1").limit(1).count():
        links = links.union(_joining(_cells(held.where("m > 1"), False), sets, percent))
        held, _ = _unsettled(stars, links, reps)
    return links.union(_joining(_cells(held, True), sets, percent))


def _shared(index: DataFrame) -> DataFrame:
    """The rows of keys that several sets have, with the key's ``pivot`` and how often it is there (``m``)."""
    dealt = index.repartition("key")  # both sides of the join are made of this one shuffle
    keys = dealt.groupBy("key").agg(F.min("sig").alias("pivot"), F.max("sig").alias("last"), F.count("*").alias("m")).where("pivot < last").drop("last")
    return dealt.join(keys, "key")


def _met(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets with a key in common whose sizes leave a link possible."""
    side = lambda s: groups.select("key", F.col("sig").alias(s))
    return side("a").join(side("b"), "key").where("a < b").where(_near_sizes("a", "b", percent)).select("a", "b")


def _unsettled(stars: DataFrame, links: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (``main``) of sets that may have links between components, and their numbers of blocks: ``m`` of all sets, ``q`` of the minor.

    Sets that share a large key share its pivot.  So the sets that are not in their pivot's component (``minor``) are
    to be compared with that component's sets and with each other.
    """
    roots = written(connected_components(links, "a", "b"))
    of = lambda c, name: roots.select(F.col("node").alias(c), F.col("component").alias(name))
    star = stars.join(of("pivot", "p"), "pivot", "left").join(of("sig", "r"), "sig", "left")
    minor = star.select(F.coalesce("p", "pivot").alias("main"), "sig", F.coalesce("r", "sig").alias("root"), F.lit(True).alias("minor")).where("main <> root").distinct()
    minor = written(minor)
    major = roots.select(F.col("component").alias("main"), F.col("node").alias("sig"), F.col("component").alias("root"), F.lit(False).alias("minor"))
    held = minor.union(major.join(minor.select("main").distinct(), "main", "left_semi")).join(reps.select("sig", "n", "bits"), "sig")
    part = F.greatest(F.lit(1 / BLOCK), F.col("n") / COUNTED_ITEMS)
    sizes = held.groupBy("main").agg(F.ceil(F.sum(part)).cast("int").alias("m"), F.ceil(F.sum(F.when(F.col("minor"), part))).cast("int").alias("q"))
    sizes = written(sizes)
    return held.join(sizes, "main"), sizes


def _cells(held: DataFrame, every: bool) -> DataFrame:
    """Blocks of minor sets against all blocks of their class, or, unless ``every``, against one."""
    block = lambda c: F.pmod(F.xxhash64("sig", F.lit(7)), F.col(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    x, y = held.where("minor").withColumn("i", block("q")), held.withColumn("j", block("m"))
    x, y = (x.withColumn("j", others("m")), y.withColumn("i", others("q"))) if every else (x.withColumn("j", F.col("i")), y.where("j < q").withColumn("i", F.col("j")))
    side = lambda cells, minor: cells.select("main", "i", "j", F.lit(minor).alias("minor"), "sig", "root", "n", "bits")
    return side(x, True).union(side(y, False))


def _joining(cells: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """Links that join all components which a link within a cell joins."""
    cell = ["main", "i", "j"]
    possible = written(cells.groupBy(*cell).applyInArrow(_possible(percent), "main bigint, i int, j int, sig bigint"))
    if not possible.limit(1).count():
        return possible.select(F.col("sig").alias("a"), F.col("sig").alias("b"))
    whole = cells.join(possible, [*cell, "sig"]).join(sets.of(possible), "sig")
    return written(whole.groupBy(*cell).applyInArrow(_joined(percent), "a bigint, b bigint"))


def _near(table: pa.Table, percent: int, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The row of each minor set with the rows of sets that sizes and bitmaps leave possible, the nearest first.

    Sets with the same ``root`` are left out; roots may change between.
    """
    minor = table.column("minor").to_numpy(zero_copy_only=False)
    n = table.column("n").to_numpy().astype(np.int64)
    flat = np.concatenate([np.asarray(c.flatten()) for c in table.column("bits").chunks]).view(np.uint64)
    words = np.concatenate([np.asarray(c.value_lengths()) for c in table.column("bits").chunks]).astype(np.int64)
    start = np.cumsum(words) - words
    rows = {w: np.flatnonzero(~minor & (words == w)) for w in np.unique(words[~minor])}
    ys = {w: (at, flat[start[at][:, None] + np.arange(w)]) for w, at in rows.items()}
    for x in np.flatnonzero(minor):
        own = flat[start[x] : start[x] + words[x]][None, :]
        found, differs = [], []
        for w, (at, bits) in ys.items():
            near = np.flatnonzero((root[at] != root[x]) & (np.minimum(n[at], n[x]) * 100 >= np.maximum(n[at], n[x]) * percent))
            if not len(near):
                continue
            both = min(w, words[x])
            size = n[at[near]] + n[x]
            differ = np.bitwise_count(_folded(bits[near], both) ^ _folded(own, both)).sum(axis=1, dtype=np.int64)
            may = differ <= size - 2 * -(-size * percent // (100 + percent))
            found.append(at[near[may]])
            differs.append(differ[may])
        if sum(map(len, found)):
            yield x, np.concatenate(found)[np.argsort(np.concatenate(differs), kind="stable")]


def _cross(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Pairs of a minor set and any set, of different roots, that sizes and bitmaps leave possible."""
        sig, root = (table.column(c).to_numpy().astype(np.int64) for c in ("sig", "root"))
        out_a, out_b = [], []
        for x, found in _near(table, percent, root):
            out_a.append(np.minimum(sig[found], sig[x]))
            out_b.append(np.maximum(sig[found], sig[x]))
        join = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64))
        return pa.table({"a": join(out_a), "b": join(out_b)})

    return run


def _possible(percent: int):
    cross = _cross(percent)

    def run(table: pa.Table) -> pa.Table:
        """The sets of a cell that have such a pair, once each."""
        pairs = cross(table)
        sigs = np.unique(np.concatenate([pairs.column(c).to_numpy() for c in ("a", "b")]))
        cell = {c: pa.repeat(table.column(c)[0], len(sigs)) for c in ("main", "i", "j")}
        return pa.table(cell | {"sig": pa.array(sigs)})

    return run


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of a cell, fewer than its sets: a set is compared with the nearest first, with none of a root it has been joined to."""
        sig, root = (table.column(c).to_numpy().astype(np.int64) for c in ("sig", "root"))
        sets = [unpack_set(x) for x in table.column("items").to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        start = np.cumsum(n) - n
        distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros(len(distinct), bool)
        links: list[tuple[int, int]] = []
        for x, near in _near(table, percent, root):
            own = place[start[x] : start[x] + n[x]]
            has[own] = True
            at_once = 4
            while len(near):
                some, near = near[:at_once], near[at_once:]
                ends = np.cumsum(n[some])
                o = np.add.reduceat(has[np.concatenate([place[start[y] : start[y] + n[y]] for y in some])], ends - n[some], dtype=np.int64)
                linked = some[o * 100 >= (n[some] + n[x] - o) * percent]
                for y in linked:
                    if root[y] != root[x]:
                        links.append((min(sig[x], sig[y]), max(sig[x], sig[y])))
                        root[root == root[y]] = root[x]
                near = near[root[near] != root[x]]
                at_once = min(4 * at_once, 1024)
            has[own] = False
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _link_counts(named: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """``others``, the rows with another set that each signature is linked to.

    All links lie within components.  The sets of a component are dealt into blocks of about ``COUNTED`` sets and
    ``COUNTED_ITEMS`` shingles at most; a task has two blocks and finds all their overlaps by products of incidence
    matrices; only sums leave it.
    """
    if not sets.parts:
        return named.sparkSession.createDataFrame([], "sig bigint, others bigint")
    sizes = named.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / COUNTED, F.col("all") / COUNTED_ITEMS)).cast("int")
    named = written(named.join(sizes, "node"))
    held = reduce(DataFrame.union, [named.join(part, "sig") for part in sets.parts]).select("node", "sig", "copies", "items", F.pmod(F.xxhash64("sig", F.lit(7)), blocks).cast("int").alias("b"), blocks.alias("blocks"))
    packed = held.groupBy("node", "b").applyInArrow(_packed, "node bigint, b int, blocks int, sigs binary, copies binary, sizes binary, items binary")
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j"))))
    cells = packed.withColumn("cell", cell).select("node", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "b", "sigs", "copies", "sizes", "items")
    counted = cells.groupBy("node", "i", "j").applyInArrow(_counted(percent), "sig bigint, others bigint")
    return counted.groupBy("sig").agg(F.sum("others").alias("others"))


def _packed(table: pa.Table) -> pa.Table:
    """A block's sets in one compressed row: near copies have most of their shingles in common."""
    sets = [unpack_set(x) for x in table.column("items").to_pylist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    zipped = lambda data: pa.array([zstandard.compress(data, 3)], pa.binary())
    whole = {"sigs": table.column("sig").to_numpy().tobytes(), "copies": table.column("copies").to_numpy().tobytes(), "sizes": sizes.tobytes(), "items": np.concatenate(sets).tobytes()}
    return pa.table({c: table.column(c).slice(0, 1) for c in ("node", "b", "blocks")} | {c: zipped(v) for c, v in whole.items()})


def _counted(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """For each set of a cell, the copies of the other block's sets (in a cell of one block, of its own) it is linked to."""
        raw = {c: [zstandard.decompress(v) for v in table.column(c).to_pylist()] for c in ("sigs", "copies", "sizes", "items")}
        sig, copies, n, items = (np.frombuffer(b"".join(raw[c]), np.int64) for c in ("sigs", "copies", "sizes", "items"))
        block = np.repeat(table.column("b").to_numpy(), [len(x) // 8 for x in raw["sigs"]])
        _, place = np.unique(items, return_inverse=True)
        often = np.bincount(place)
        shared = np.flatnonzero(often > 1)  # what one set alone has adds to no overlap
        column = np.full(len(often), -1, np.int64)
        column[shared] = np.arange(len(shared))
        cols = column[place]
        rows, cols = np.repeat(np.arange(len(n)), n)[cols >= 0], cols[cols >= 0]
        order = np.argsort(cols, kind="stable")
        rows, cols = rows[order], cols[order]
        x = np.flatnonzero(block == block.min())
        y = np.flatnonzero(block == block.max())
        overlap = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, len(shared), 2048):
            a, b = np.searchsorted(cols, (at, at + 2048))
            has = np.zeros((len(n), min(2048, len(shared) - at)), np.float32)
            has[rows[a:b], cols[a:b] - at] = 1
            overlap += has[x] @ has[y].T
        others = np.zeros(len(n), np.int64)
        for at in range(0, len(x), 256):
            some = x[at : at + 256]
            o = overlap[at : at + 256].astype(np.int64)
            linked = o * 100 >= (n[some][:, None] + n[y][None, :] - o) * percent
            linked &= some[:, None] != y[None, :]
            others[some] += linked @ copies[y]
            if block.min() != block.max():
                others[y] += copies[some] @ linked
        return pa.table({"sig": pa.array(sig), "others": pa.array(others)})

    return run
