"""Removal of long repeated substrings by a distributed merge sort of suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a
document with a smaller id.  Any two equal strings of that length share an
anchor: a ``GRAM``-byte piece whose hash is least among the ``LENGTH - GRAM +
1`` pieces of the string.  So only suffixes that start at anchors are sorted.

1. Blocks: documents are packed into blocks of about ``BLOCK_BYTES``, a table
   bucketed by block.  All later steps send to a block only what it asked for;
   the texts themselves are never shuffled.
2. Seeds: each block's distinct anchor hashes, sorted and delta-coded, meet by
   hash; a block learns which of its anchors two documents or more have (a
   filter that can only let too much through).
3. Runs: per block, the suffixes at these anchors (``LENGTH`` bytes from the
   anchor on, then the bytes before it, backwards) are sorted, equal ones are
   one entry with the least document id, and the run is front-coded: the
   length of the prefix shared with the suffix before, and the rest.  Runs are
   cut at sampled splitters and exchanged by range; where a range is one hot
   prefix, its suffixes are dealt by their next bytes.
4. Merge: the runs of a range are combined by a loser tree that keeps each
   loser's common prefix with its winner, so known prefixes are never compared
   again.  The merged order and its common prefixes decide: the suffixes that
   share the 50 - r bytes from the anchor on are a stretch of it in which no
   common prefix is shorter, and those that share the r bytes before it are
   such a stretch of the order of left contexts.  The least id of both
   stretches' common part is the verdict on the string that starts r bytes
   before the anchor.  It returns to the blocks that have the suffix.
5. Blocks cut out the bytes of strings that an earlier document has.

A string that many documents share travels once a block, with one id.

Defined results: null and empty texts have no bytes; rows that repeat a
document have its id and so don't delete each other; a null id neither deletes
nor loses anything; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import written, written_buckets

LENGTH = 50
GRAM = 16
SPARE = LENGTH - GRAM
WIDTH = LENGTH + 1 + SPARE + 1
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 19
BUCKET_BYTES = 32 << 20
SEEDS_A_PART = 1 << 20
SUFFIXES_A_PART = 1 << 18
SAMPLES_A_BLOCK = 64

_NONE = np.iinfo(np.int64).max
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _slide(a: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over every window of ``width``, by doubling."""
    have = 1
    while 2 * have <= width:
        a = best(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return best(a[:-rest], a[rest:]) if rest else a


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of every GRAM (16) bytes."""
    a = raw.astype(np.uint64)
    for step in (1, 2, 4):
        a = a[:-step] | (a[step:] << np.uint64(8 * step))
    h = a[:-8] * _C1 ^ ((a[8:] * _C2) >> np.uint64(17)) ^ (a[8:] << np.uint64(29))
    h = (h ^ (h >> np.uint64(32))) * _C3
    return h ^ (h >> np.uint64(29)) | np.uint64(1)


def anchors(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand one after another; every ``LENGTH`` bytes of a text hold one."""
    places, hashes = [], []
    ends = np.cumsum(sizes)
    first, at = 0, 0
    while first < len(sizes):  # some texts at a time, so that the arrays stay small
        last = max(first + 1, int(np.searchsorted(ends, at + CHUNK_BYTES, "right")))
        end = int(ends[last - 1])
        part = raw[at:end]
        if len(part) >= LENGTH:
            h = gram_hashes(part)
            least = _slide(h, SPARE + 1, np.minimum)
            inside = np.zeros(len(part) + 1, np.int32)  # strings that don't reach into the next text
            starts = ends[first:last] - sizes[first:last] - at
            full = sizes[first:last] >= LENGTH
            inside[starts[full]] += 1
            inside[(ends[first:last] - at - LENGTH + 1)[full]] -= 1
            least[np.cumsum(inside)[: len(least)] == 0] = 0
            pad = np.zeros(SPARE, np.uint64)
            found = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), SPARE + 1, np.maximum) == h)
            places.append(found + at)
            hashes.append(h[found])
        first, at = last, end
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _packed(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the high planes of small numbers vanish."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _batch(names: str, kinds: tuple, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names.split())


# ---- 1. Blocks -------------------------------------------------------------

_BLOCK = "block bigint, ids array<bigint>, sizes array<bigint>, packed binary, sample array<bigint>"


def _prefix(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that orders as they do (but for the last bit)."""
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)[at]
    return (np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64) >> np.uint64(1)).astype(np.int64)


def _pack(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            raw = b"".join(texts)
            a = np.frombuffer(raw, np.uint8)
            sample = _prefix(a, np.linspace(0, len(a) - 8, SAMPLES_A_BLOCK).astype(np.int64)) if len(a) >= LENGTH else np.zeros(0, np.int64)
            row = (part << 32 | seq, ids, [len(t) for t in texts], zstandard.compress(raw, 3), sample.tolist())
            return _batch("block ids sizes packed sample", (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())), [row])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append((text or "").encode("utf-8", "surrogatepass"))
                    held += len(texts[-1])
                    if held >= block_bytes:
                        yield block()
                        ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield block()

    return run


class Block:
    """The texts of a block and its anchors."""

    def __init__(self, ids: list[int | None], sizes: list[int], packed: bytes) -> None:
        self.raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
        self.known = np.array([i is not None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def find(self, parts: int) -> None:
        """Anchors, by part and value of their hash: ``at``, ``row`` and ``slot`` of each, ``part`` and ``value`` of each slot."""
        at, h = anchors(self.raw, self.sizes)
        row = np.searchsorted(self.starts, at, "right") - 1
        # Empty texts begin where the next one does; the last text that begins there is the one with bytes.
        keep = self.known[row]
        at, h, row = at[keep], h[keep], row[keep]
        part, value = ((h >> np.uint64(44)) % np.uint64(parts)).astype(np.int64), h & np.uint64((1 << 44) - 1)
        order = np.lexsort((value, part))
        self.at, self.row, part, value = at[order], row[order], part[order], value[order]
        first = np.ones(len(part), bool)
        first[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1])
        self.slot = np.cumsum(first) - 1
        self.slots = np.flatnonzero(first)
        self.part, self.value = part[first], value[first]
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


# ---- 2. Seeds --------------------------------------------------------------


def _seeds(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, *block in _blocks_of(batches):
            b = Block(*block)
            b.find(parts)
            if not len(b.at):
                continue
            docs = b.ids[b.row]
            several = np.minimum.reduceat(docs, b.slots) != np.maximum.reduceat(docs, b.slots)
            rows = [
                (p, number, _packed(np.diff(b.value[x:y], prepend=np.uint64(0))), np.packbits(several[x:y]).tobytes())
                for p, (x, y) in enumerate(zip(b.cuts[:-1].tolist(), b.cuts[1:].tolist(), strict=True))
                if x < y
            ]
            yield _batch("part block value several", (pa.int32(), pa.int64(), pa.binary(), pa.binary()), rows)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each block, which of its hashes of this part two documents or more have."""
    blocks = table.column("block").to_pylist()
    values = [np.cumsum(_unpacked(v, "<u8")) for v in table.column("value").to_pylist()]
    sizes = [len(v) for v in values]
    several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(table.column("several").to_pylist(), sizes, strict=True)])
    value = np.concatenate(values)
    del values
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    starts = np.flatnonzero(first)
    many = (np.diff(starts, append=len(value)) > 1) | (np.maximum.reduceat(several[order], starts) > 0)
    shared = np.zeros(len(value), bool)
    shared[order] = np.repeat(many, np.diff(starts, append=len(value)))
    cuts = np.cumsum(sizes)
    rows = [(b, p, np.packbits(shared[c - n : c]).tobytes(), int(shared[c - n : c].sum())) for b, p, c, n in zip(blocks, table.column("part").to_pylist(), cuts, sizes, strict=True)]
    return pa.Table.from_batches([_batch("block part bits n", (pa.int64(), pa.int32(), pa.binary(), pa.int64()), rows)])


# ---- 3. Runs ---------------------------------------------------------------


def suffixes(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row for each anchor: the LENGTH bytes from it on and how many there are in its text, the SPARE bytes
    before it, backwards, and how many there are."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    padded = np.concatenate([np.zeros(SPARE, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, SPARE + LENGTH)[at]
    right, left = np.minimum(end - at, LENGTH), np.minimum(at - start, SPARE)
    out[:, :LENGTH] = np.where(np.arange(LENGTH) < right[:, None], around[:, SPARE:], 0)
    out[:, LENGTH] = right
    out[:, LENGTH + 1 : -1] = np.where(np.arange(SPARE) < left[:, None], around[:, SPARE - 1 :: -1], 0)
    out[:, -1] = left
    return out


def _by_bytes(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each of the sorted rows shares with the one before (0 for the first)."""
    same = rows[1:] == rows[:-1]
    return np.concatenate([np.zeros(min(1, len(rows)), np.int64), np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))])


def front_code(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted rows as shared prefix lengths and the rest."""
    shared = prefixes(rows)
    return shared.astype(np.uint8).tobytes(), rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def read_run(shared: bytes, tails: bytes, width: int, number: int = 0) -> Iterator[tuple[int, bytes, int]]:
    """(shared prefix, string, running number) of a front-coded run."""
    before, at = b"", 0
    for n in shared:
        before = before[:n] + tails[at : at + width - n]
        at += width - n
        yield n, before, number
        number += 1


_RUN = "part int, block bigint, shared binary, tails binary, least binary, counts binary, rows binary, places binary"


def _runs(parts: int, splitters: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.array(splitters, np.int64)
        for number, ids, sizes, packed, found in _blocks_of(batches):
            b = Block(ids, sizes, packed)
            b.find(parts)
            chosen = np.zeros(len(b.part), bool)
            for p in found:
                x, y = b.cuts[p["part"]], b.cuts[p["part"] + 1]
                chosen[x:y] = np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=int(y - x)) > 0
            keep = chosen[b.slot]
            at, row = b.at[keep], b.row[keep]
            head = _prefix(b.raw, at)
            lo, hi = np.searchsorted(split, head, "left"), np.searchsorted(split, head, "right")
            part = lo + (_prefix(b.raw, at + 8) % 1_000_003) % np.maximum(hi - lo, 1)
            order = np.argsort(part, kind="stable")
            at, row, part = at[order], row[order], part[order]
            rows = []
            for x in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
                y = int(np.searchsorted(part, part[x], "right"))
                a, r = at[x:y], row[x:y]
                s = suffixes(b.raw, a, b.starts[r], b.starts[r] + b.sizes[r])
                by = _by_bytes(s)
                s, a, r = s[by], a[by], r[by]
                new = prefixes(s) < WIDTH
                first = np.flatnonzero(new)
                least = np.minimum.reduceat(b.ids[r], first)
                counts = np.diff(first, append=len(a)).astype("<u4")
                shared, tails = front_code(s[first])
                zip_ = lambda v: zstandard.compress(v, 3)
                rows.append((int(part[x]), number, zip_(shared), zip_(tails), _packed(least), _packed(counts), _packed(r.astype("<u4")), _packed((a - b.starts[r]).astype("<u4"))))
            if rows:
                yield _batch("part block shared tails least counts rows places", (pa.int32(), pa.int64(), *(pa.binary(),) * 6), rows)

    return run


# ---- 4. Merge --------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at again."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (prefix shared with the run's string before, string, payload).

    Each stream keeps the length of the prefix its head shares with the string
    that beat it last.  Of two heads, the one that shares more with the last
    output is smaller; only where both share as much are bytes compared, from
    there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]) -> None:
        self.runs, k = runs, len(runs)
        self.head: list[bytes | None] = [None] * k
        self.load: list[object] = [None] * k
        self.lcp = [-1] * k
        for i in range(k):
            self._advance(i)
        self.tree = [0] * max(1, k)
        winners = [0] * (2 * k)
        winners[k:] = range(k)
        for node in range(k - 1, 0, -1):
            winners[node], self.tree[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1] if k > 1 else 0

    def _advance(self, i: int) -> None:
        got = next(self.runs[i], None)
        if got is None:
            self.head[i], self.lcp[i] = None, -1
        else:
            self.lcp[i], self.head[i], self.load[i] = got

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        known, other = self.lcp[a], self.lcp[b]
        if known != other:
            return (a, b) if known > other else (b, a)
        x, y = self.head[a], self.head[b]
        if x is None:
            return a, b
        n = common_prefix(x, y, known)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        k, top, tree, lcp, play, advance = len(self.runs), self.top, self.tree, self.lcp, self._play, self._advance
        while k and self.head[top] is not None:
            yield lcp[top], self.head[top], self.load[top]
            advance(top)
            node = (k + top) // 2
            while node:
                other = tree[node]
                if lcp[top] <= lcp[other]:
                    top, tree[node] = play(top, other)
                node //= 2


def verdicts(rows: np.ndarray, shared: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct suffixes in merged order, with their common prefixes and least ids: the least id that decides on
    the strings around each anchor; and the suffixes where it depends on the string, with an id for each string.

    String r starts r bytes before the anchor; ids of strings that a suffix doesn't hold are the largest number.
    """
    right, left = rows[:, LENGTH].astype(np.int64), rows[:, -1].astype(np.int64)
    shared = np.minimum(shared, LENGTH)
    new = shared < GRAM
    new[:1] = True
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    base = least.copy()
    if not len(several):
        return base, several, np.zeros((0, SPARE + 1), np.int64)
    shared, own = np.where(new, 0, shared)[several], least[several]
    right, left = right[several], left[several]
    before = rows[several, LENGTH + 1 : -1]
    order = _by_bytes(before)
    fits = prefixes(before[order])
    table = np.full((len(several), SPARE + 1), _NONE, np.int64)
    for r in range(SPARE + 1):
        has = np.flatnonzero((right >= LENGTH - r) & (left >= r))
        if not len(has):
            continue
        stretch = np.cumsum(shared < LENGTH - r)  # of suffixes that share what follows
        other = np.empty(len(several), np.int64)  # of those that share what precedes
        other[order] = np.cumsum(fits < r)
        key = stretch[has] * (len(several) + 1) + other[has]
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        table[has[by], r] = np.repeat(np.minimum.reduceat(own[has[by]], first), np.diff(first, append=len(by)))
    low = table.min(axis=1)
    high = np.where(table == _NONE, low[:, None], table).max(axis=1)
    base[several] = low
    return base, several[low < high], table[low < high]


def _merged(table: pa.Table) -> pa.Table:
    """Verdicts on each run's suffixes, from the merged order of the range."""
    blocks, parts = table.column("block").to_pylist(), table.column("part").to_pylist()
    streams, least, cuts = [], [], [0]
    for shared, tails, low in zip(*(table.column(c).to_pylist() for c in ("shared", "tails", "least")), strict=True):
        least.append(_unpacked(low, "<i8"))
        streams.append(read_run(zstandard.decompress(shared), zstandard.decompress(tails), WIDTH, cuts[-1]))
        cuts.append(cuts[-1] + len(least[-1]))
    least = np.concatenate(least)
    base, place = np.empty(cuts[-1], np.int64), np.full(cuts[-1], -1, np.int64)
    tables: list[np.ndarray] = []
    lcps: list[int] = []
    numbers: list[int] = []
    strings: list[bytes] = []
    seen = 0

    def settle() -> None:
        nonlocal seen
        which, shared = np.array(numbers, np.int64), np.array(lcps, np.int64)
        first = np.flatnonzero(shared < WIDTH)
        context = np.cumsum(shared < WIDTH) - 1
        rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, WIDTH)
        low, varied, ids = verdicts(rows, shared[first], np.minimum.reduceat(least[which], first))
        base[which] = low[context]
        at = np.full(len(first), -1, np.int64)
        at[varied] = seen + np.arange(len(varied))
        place[which] = at[context]
        tables.append(ids)
        seen += len(varied)
        lcps.clear(), numbers.clear(), strings.clear()

    for n, s, number in LoserTree(streams):
        if n < WIDTH:
            if n < GRAM and len(strings) >= 1 << 15:
                settle()
            strings.append(s)
            lcps.append(n if numbers else 0)
        else:
            lcps.append(n)
        numbers.append(number)
    if numbers:
        settle()
    ids = np.concatenate(tables) if tables else np.zeros((0, SPARE + 1), np.int64)
    rows = []
    for b, p, x, y in zip(blocks, parts, cuts[:-1], cuts[1:], strict=True):
        at = np.flatnonzero(place[x:y] >= 0)
        rows.append((b, p, _packed(base[x:y]), _packed(at.astype("<u4")), _packed(ids[place[x:y][at]].ravel())))
    return pa.Table.from_batches([_batch("block part base varied ids", (pa.int64(), pa.int32(), *(pa.binary(),) * 3), rows)])


# ---- 5. Cutting ------------------------------------------------------------


def strings_to_cut(b: Block, runs: list[dict], told: list[dict]) -> np.ndarray:
    """Where the strings start that an earlier document has."""
    start = np.zeros(len(b.raw), bool)
    verdict = {v["part"]: v for v in told}
    for run in runs:
        v = verdict[run["part"]]
        base, varied = _unpacked(v["base"], "<i8"), _unpacked(v["varied"], "<u4").astype(np.int64)
        ids = _unpacked(v["ids"], "<i8").reshape(-1, SPARE + 1)
        context = np.repeat(np.arange(len(base)), _unpacked(run["counts"], "<u4").astype(np.int64))
        row, place = _unpacked(run["rows"], "<u4").astype(np.int64), _unpacked(run["places"], "<u4").astype(np.int64)
        hit = b.ids[row] > base[context]  # later than the least id of any of its strings
        context, row, place = context[hit], row[hit], place[hit]
        at = np.full(len(base), -1, np.int64)
        at[varied] = np.arange(len(varied))
        own, doc, where, size = at[context], b.ids[row], b.starts[row] + place, b.sizes[row]
        mixed = own >= 0
        for r in range(SPARE + 1):
            cut = (place >= r) & (place - r + LENGTH <= size)
            cut[mixed] &= doc[mixed] > ids[own[mixed], r]
            start[where[cut] - r] = True
    return start


def _cuts(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for ids, sizes, packed, runs, told in _blocks_of(batches):
            b = Block(ids, sizes, packed)
            so_far = np.cumsum(strings_to_cut(b, runs or [], told or []), dtype=np.int32)
            so_far[LENGTH:] -= so_far[:-LENGTH].copy()
            gone = so_far > 0  # a string starts here or up to LENGTH - 1 bytes before; strings end within their text
            rows = []
            for doc_id, a, n in zip(ids, b.starts.tolist(), sizes, strict=True):
                raw, g = b.raw[a : a + n], gone[a : a + n]
                removed = int(np.count_nonzero(g))
                spans = int(np.count_nonzero(g[1:] > g[:-1])) + int(g[0]) if removed else 0
                kept = raw[~g].tobytes() if removed else raw.tobytes()
                rows.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield _batch("doc_id n_bytes n_removed n_spans kept_sha256 kept", kinds, rows)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``texts``, the ``kept`` bytes."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # With fewer buckets than shuffle partitions, Spark would deal the blocks anew for the sake of parallelism.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    blocks = written_buckets(base.mapInArrow(_pack(block_bytes), _BLOCK), buckets, "block")
    parts = max(1, -(-total * 2 // (SPARE + 2) // SEEDS_A_PART))
    seeds = blocks.select("block", "ids", "sizes", "packed").mapInArrow(_seeds(parts), "part int, block bigint, value binary, several binary")
    shared = written(seeds.groupBy("part").applyInArrow(_shared, "block bigint, part int, bits binary, n bigint"))
    found = shared.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("found"))
    ranges = max(1, -(-(shared.agg(F.sum("n")).first()[0] or 0) // SUFFIXES_A_PART))
    cuts = [i / ranges for i in range(1, ranges)]
    at = blocks.select(F.explode("sample").alias("x")).distinct().agg(F.percentile_approx("x", cuts, 100_000)).first()[0] if cuts else []
    runs = written(blocks.join(found, "block").select("block", "ids", "sizes", "packed", "found").mapInArrow(_runs(parts, at or []), _RUN))
    merged = runs.select("part", "block", "shared", "tails", "least").groupBy("part").applyInArrow(_merged, "block bigint, part int, base binary, varied binary, ids binary")
    told = merged.groupBy("block").agg(F.collect_list(F.struct("part", "base", "varied", "ids")).alias("told"))
    own = runs.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "rows", "places")).alias("runs"))
    judged = blocks.join(own, "block", "left").join(told, "block", "left").select("ids", "sizes", "packed", "runs", "told")
    out = judged.mapInArrow(_cuts(texts), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")
