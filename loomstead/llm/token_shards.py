"""Token ids in a binary format, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned by id, tokenised, and cut into shards of about
``SHARD_IDS`` ids in ascending id order.  Per shard, frequent id pairs are
replaced by new nonterminals again and again; the shard stores the rules, the
expansion length of each symbol and a directory of documents, so that any
document (or id range) is decoded from the symbols that cover it alone.

A shard row of the format:

    part, seq     place in the order of shards
    base          first nonterminal; ids below it are plain
    left, right   little-endian uint32, one rule per nonterminal
    length        little-endian uint32, ids a nonterminal expands to
    symbols       little-endian uint32 start sequence
    doc_ids, doc_ends   documents of the shard and where each ends in ids

Defined results: a null or empty text is the end id alone; repeated rows are
repeated documents side by side; null ids come first; other columns are
ignored; an empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from itertools import compress as compress_by
from operator import and_, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.session import shared_dir

SHARD_IDS = 1 << 20
#: A pair is replaced if it occurs so often.  A rule takes three numbers, and each replacement saves one: from four on it pays.
LEAST_PAIR = 4
ENCODE_BYTES = 2 << 20
CACHE_WORDS = 400_000

SHARD_SCHEMA = (
    "part int, seq int, base int, left binary, right binary, length binary, symbols binary, "
    "doc_ids array<bigint>, doc_ends array<bigint>"
)


# ---- Re-Pair ---------------------------------------------------------------


def _pairs(symbols: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The places ``at`` by pair and then place, the pair at each as one number, and the bits of its second symbol.

    Where two symbols and a place fit 63 bits, numbers made of all three are sorted: each tells its pair and its place
    again, and nothing is looked up in the order of pairs."""
    wide, far = int(top).bit_length(), len(symbols).bit_length()
    whole = len(at) == len(symbols) - 1
    left, right = (symbols[:-1] if whole else symbols[at]).astype(np.int64), symbols[1:] if whole else symbols[at + 1]
    if 2 * wide + far > 63:
        pairs = (left << 32) | right
        order = np.argsort(pairs, kind="stable")
        return at[order], pairs[order], 32
    both = np.sort(((left << wide | right) << far) | at)
    return both & ((1 << far) - 1), both >> far, wide


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of places that follow one another (a pair of equal symbols overlaps itself), every other one."""
    begins = np.diff(at, prepend=-2) != 1
    if begins.all():
        return at
    first = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


def compress(ids: np.ndarray, base: int, least: int = LEAST_PAIR) -> dict:
    """Re-Pair over one shard, until no pair occurs ``least`` times.

    A round ranks the pairs by how often they occur and gives each frequent
    pair its own nonterminal, most frequent first; where replacements would
    overlap, the more frequent pair stands.  A pair that is rare stays rare: new
    pairs come only where something was replaced.  So each round counts only
    the pairs beside replaced places and the frequent ones that are left.
    Lengths are those of the expansions.
    """
    symbols = ids.astype(np.int32 if base + len(ids) < 1 << 31 else np.int64)
    left, right, length = [], [], np.ones(0, np.int64)
    top = base
    alive = np.arange(max(0, len(symbols) - 1))  # places whose pair may be frequent
    rare = np.iinfo(np.int32).max
    while len(alive):
        at, pairs, wide = _pairs(symbols, alive, top)
        starts = np.flatnonzero(np.diff(pairs, prepend=pairs[0] - 1))
        counts = np.diff(starts, append=len(pairs))
        often = counts >= least
        if not often.any():
            break
        kinds, counts_often = pairs[starts[often]], counts[often]
        by_count = np.argsort(-counts_often, kind="stable")
        ranks = np.empty(len(kinds), np.int32)
        ranks[by_count] = np.arange(len(kinds), dtype=np.int32)
        code = np.full(len(symbols) + 1, rare, np.int32)  # by place; one on each side has no pair
        code[at[np.repeat(often, counts)] + 1] = np.repeat(ranks, counts_often)
        again = code[1:] != rare
        here = code[1:-1]
        hit = again[:-1] & (here <= code[:-2]) & (here <= code[2:])
        chosen = _alternate(np.flatnonzero(hit))
        rank = here[chosen]
        used = np.flatnonzero(np.bincount(rank, minlength=len(kinds)))
        name = np.empty(len(kinds), symbols.dtype)
        name[used] = top + np.arange(len(used))
        symbols[chosen] = name[rank]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        again[chosen] = True
        again[np.maximum(chosen - 1, 0)] = True
        symbols = symbols[keep]
        alive = np.flatnonzero(again[keep])
        alive = alive[alive < len(symbols) - 1]
        lo, hi = kinds[by_count[used]] >> wide, kinds[by_count[used]] & ((1 << wide) - 1)
        known = np.append(length, 1)  # the last stands for plain ids
        size = lambda s: known[np.where(s < base, -1, s - base)]  # noqa: B023, E731
        left.append(lo)
        right.append(hi)
        length = np.concatenate([length, size(lo) + size(hi)])
        top += len(used)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return {"base": base, "left": join(left), "right": join(right), "length": length, "symbols": symbols.astype(np.int64)}


def _copied(out: np.ndarray, to: np.ndarray, table: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """``out[to : to + n] = table[at : at + n]`` for each of many stretches."""
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + step] = table[np.repeat(at, n) + step]


class Grammar:
    """The plain ids that each nonterminal of a shard stands for, one after another."""

    def __init__(self, shard: dict) -> None:
        self.base, left, right, self.length = shard["base"], shard["left"], shard["right"], shard["length"]
        self.starts = np.cumsum(self.length) - self.length
        self.flat = np.empty(int(self.length.sum()), np.int64)
        done = np.zeros(len(left) + 1, bool)
        done[-1] = True  # plain ids
        todo = np.arange(len(left))
        place = lambda s: np.where(s < self.base, -1, s - self.base)
        while len(todo):
            ready = done[place(left[todo])] & done[place(right[todo])]
            now, todo = todo[ready], todo[~ready]
            self._fill(self.starts[now], left[now])
            self._fill(self.starts[now] + self.size(left[now]), right[now])
            done[now] = True

    def size(self, symbols: np.ndarray) -> np.ndarray:
        return np.append(self.length, 1)[np.where(symbols < self.base, -1, symbols - self.base)]

    def _fill(self, to: np.ndarray, symbols: np.ndarray, out: np.ndarray | None = None) -> None:
        out, deep = self.flat if out is None else out, symbols >= self.base
        out[to[~deep]] = symbols[~deep]
        rule = symbols[deep] - self.base
        _copied(out, to[deep], self.flat, self.starts[rule], self.length[rule])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        size = self.size(symbols)
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        self._fill(ends - size, symbols, out)
        return out


def slice_ids(shard: dict, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a shard, from the covering symbols only."""
    symbols, ends = shard["symbols"], shard["ends"]
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
    skip = start - (ends[a - 1] if a else 0)
    return shard["grammar"].expand(symbols[a:b])[skip : skip + end - start]


# ---- Tokenising ------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker process: what it knows of words serves all of the worker's tasks, which have a core each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


# A dot or comma after a byte that may belong to another mark: then marks are left as they stand.
# Bytes by class tell at once where there is none: letters, digits and spaces (a), other marks (!), rarer scripts (L).
_CLASSES = bytes(
    97 if chr(b).isalnum() and b < 128 or b in b" \t\n\r\v\f" else 46 if b in b".," else 33 if b < 128 or b in (0x97, 0xB7) else 97 if b < 0xC0 or b == 0xC3 else 76
    for b in range(256)
)
_RUNS = re.compile(rb"[^\x09-\x0d\x20A-Za-z0-9\x80-\xbf][.,]|(?<!\xc3)[\x80-\xbf][.,]|\xc3[\x97\xb7][.,]")


def prepared(text: str | None) -> bytes:
    """The text's bytes, such that the tokenizer encodes their white-space separated pieces one by one anyway.

    It folds case, drops white space and parts letters from marks; so ASCII is
    folded and dots and commas after letters, digits or spaces are set apart,
    which leaves fewer distinct pieces.  Texts with its special tokens are left
    as they are.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if b"<|" in raw:
        return raw
    raw = raw.lower()
    classes = raw.translate(_CLASSES)
    apart = not (b"!." in classes or b".." in classes) if b"L" not in classes else not _RUNS.search(raw)
    return raw.replace(b".", b" .").replace(b",", b" ,") if apart else raw


_INSIDE = np.array([b not in b" \t\n\r\v\f" for b in range(256)])


def pieces(raws: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pieces of the texts, and how many there are up to each text's end."""
    raw = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    inside = np.concatenate([[False], _INSIDE[raw]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:]])])
    return found.dictionary_encode(), np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))


# A word of a-z and Latin letters from U+00DF on (single code points in lower case, which no normal form changes), and marks other than '.
_LATIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
# Byte-level letters of the bytes of such words, in UTF-16: 0x80 to 0xA0 and 0xAD have others than their own.
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[0x80:0xA1] = np.arange(0x122, 0x143)
_LETTERS[0xAD] = 0x143
# What the file does before its model; in other files the model isn't asked alone.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of texts by way of their pieces, each of which is encoded once.

    The memory of pieces is emptied when it holds ``CACHE_WORDS``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The model alone, for words that the file's normalizer and its cuts leave as they stand.
        self.model = None
        parts = json.loads(self.tokenizer.to_str())
        if (parts["normalizer"], parts["pre_tokenizer"]) == (_NORMALIZER, _CUTS):
            self.model = Tokenizer.from_file(path)
            self.model.normalizer, self.model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.size = max([0, *self.tokenizer.get_vocab().values()]) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[ends] = True
        self.known: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.__dict__.pop("table", None)
        self.flat, self.sizes, self.total = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0

    def _learn(self, new: list[bytes]) -> None:
        """Most pieces are encoded many at a time: words of letters alone, and lower-case Latin ones with marks behind
        them, which are two words.  Each word ends in a closing id.  Latin words need no more than the model."""
        flat = lambda many: np.fromiter(chain.from_iterable(many), np.int32)
        groups = lambda words, gap: [gap.join(words[b : b + 250]) for b in range(0, len(words), 250)]
        lists = lambda by, texts: [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            ascii = list(map(and_, map(bytes.isalpha, some), map(bytes.islower, some))) if self.model else [False] * len(some)
            plain, rest = list(compress_by(some, ascii)), list(compress_by(some, map(not_, ascii)))
            found = list(map(_LATIN.fullmatch, rest)) if self.model else [None] * len(rest)
            marked = [m for m in found if m]
            rest = [w for w, m in zip(rest, found, strict=True) if not m]
            texts = [w.decode("utf-8", "replace") for w in rest]
            alpha = list(map(str.isalpha, texts))
            other = list(compress_by(texts, map(not_, alpha)))
            order = [*plain, *(m[0] for m in marked), *compress_by(rest, alpha), *compress_by(rest, map(not_, alpha))]
            latin = groups(plain + [m[1] + b" " + m[2] if m[2] else m[1] for m in marked], b" ")
            words = np.ones(len(some) - len(other), np.int64)
            words[len(plain) : len(plain) + len(marked)] += np.fromiter((m[2] != b"" for m in marked), bool, len(marked))
            ids = lists(self.model, [_LETTERS[np.frombuffer(g, np.uint8)].tobytes().decode("utf-16-le") for g in latin]) if latin else []
            ids = flat(ids + lists(self.tokenizer, groups(list(compress_by(texts, alpha)), " ")))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == words.sum():
                ends = ends[np.cumsum(words) - 1]
            else:  # some letters closed no word or several: one by one then
                other, order, ids, ends = [w.decode("utf-8", "replace") for w in some], some, ids[:0], ends[:0]
            single = lists(self.tokenizer, other)
            self.known.update(zip(order, range(self.total, self.total + len(order)), strict=True))
            self.total += len(order)
            self.flat += [ids, flat(single)]
            self.sizes += [np.diff(ends, prepend=0), np.fromiter(map(len, single), np.int64, len(single))]

    def __call__(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by ``end_id``, and the number of each text's ids."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        words, cuts = pieces([prepared(t) for t in texts])
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [names[i] for i in unknown.tolist()]
            self._learn(new)
            place[unknown] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        if len(self.flat) > 1 or not hasattr(self, "table"):
            self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
            sizes = np.append(self.sizes[0], 1)
            self.table = np.append(self.flat[0], np.int32(end_id)), np.cumsum(sizes) - sizes, sizes
        flat, starts, sizes = self.table
        code = place[words.indices.to_numpy(zero_copy_only=False)]
        code = np.insert(code, cuts, len(starts) - 1)
        cuts = cuts + np.arange(1, len(cuts) + 1)
        n = sizes[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[code] - (ends - n), n) + np.arange(ends[-1])] if len(ends) else np.zeros(0, np.int32)
        doc_ends = ends[cuts - 1]
        return ids, np.diff(doc_ends, prepend=0)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts in groups of about ENCODE_BYTES."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            ids += some.column(0).to_pylist()
            texts += some.column(1).to_pylist()
            held += some.column(1).nbytes
            if held >= ENCODE_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _shards(path: str, end_id: int, shard_ids: int, least: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(path)
        base = max(encode.size, end_id + 1)
        docs, ids, sizes, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            got = compress(np.concatenate(ids), base, least)
            pack = lambda a: a.astype("<u4").tobytes()
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "base": pa.array([base], pa.int32()),
                    **{k: pa.array([pack(got[k])], pa.binary()) for k in ("left", "right", "length", "symbols")},
                    "doc_ids": pa.array([docs], pa.list_(pa.int64())), "doc_ends": pa.array([np.cumsum(sizes)], pa.list_(pa.int64())),
                }
            )

        for some, texts in _texts(batches):
            got, n = encode(texts, end_id)
            docs += some
            ids.append(got)
            sizes += n.tolist()
            held += len(got)
            if held >= shard_ids:
                yield shard()
                docs, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    return build


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    partitions: int | None = None, shard_ids: int = SHARD_IDS, least: int = LEAST_PAIR,
) -> None:
    """Tokenise ``docs`` and write shards, in ascending id order, below ``path``.

    The one shuffle moves (id, text) into id ranges, in which a hash of the text parts
    the rows of one id; ids are made after it, so that finding the ranges doesn't tokenise.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .withColumn("mark", F.xxhash64("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "mark")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "mark")
        .select("doc_id", "text")
        .mapInArrow(_shards(tokenizer, end_id, shard_ids, least), SHARD_SCHEMA)
        .write.parquet(path)
    )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _unpack(row: dict) -> dict:
    shard = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("left", "right", "length", "symbols")} | {"base": row["base"]}
    shard["grammar"] = Grammar(shard)
    shard["ends"] = np.cumsum(shard["grammar"].size(shard["symbols"]))
    return shard


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = _unpack(row)
            ids = shard["grammar"].expand(shard["symbols"]).astype("<u4")
            ends = np.array(row["doc_ends"], np.int64)
            starts = np.append(0, ends[:-1])
            n = len(ends)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "inner": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
            )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = _unpack(row)
            starts = [0, *row["doc_ends"][:-1]]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "ids": pa.array([slice_ids(shard, a, b) for a, b in zip(starts, row["doc_ends"], strict=True)], pa.list_(pa.int32())),
                }
            )


def decode(shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document, each read through the random-access path."""
    return shards.mapInArrow(_decoded, "doc_id bigint, ids array<int>")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: a sum over parts, then within the part; both over shard heads only."""
    heads = shards.select("part", "seq", F.coalesce(F.element_at("doc_ends", -1), F.lit(0)).alias("n"))
    parts = heads.groupBy("part").agg(F.sum("n").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "seq", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("seq_start"))
    return heads.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))


def digests(shards: DataFrame) -> DataFrame:
    """Place, number and checksum of each document's ids, as read from the shards."""
    docs = shards.mapInArrow(_digests, "part int, seq int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` as shards into the shared folder, and return the digests of what was written."""
    path = shared_dir(docs.sparkSession)
    write_shards(docs, path, tokenizer, **options)
    return digests(read_shards(docs.sparkSession, path))
