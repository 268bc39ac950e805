"""Alignment of two tokenizers' tokens by the bytes they cover.

A task tokenises a batch of texts and finds, for both tokenizers, the byte at
which each token ends.  Bytes at which tokens of both end cut the documents
into groups, and the two tokens that end there are linked; all of it is array
work, linear in tokens and bytes.  The rest is Spark's: links of
the whole corpus are counted by pair, and the counts go back to the documents.

Pairs are few against links, but unbounded, and a pair may hold a third of
all links.  So the pairs of at least one in ``HOT`` links, of which there are at
most ``HOT``, are broadcast; every other pair is joined by a shuffle in which
none holds more than that part of the rows.

Texts are cut at spaces after other than white space: no token of the first
tokenizer spans such a place, nor does one of the second, whose pieces hold
spaces at their beginning only (checked when it is loaded).  What stands
between is looked up in a bounded table.

Defined results: a null or empty text, and one whose tokens don't spell it (a
character that the second tokenizer writes as a space), has no tokens, zeros
and an empty digest; repeated rows are documents of their own, and each counts;
other columns are ignored; tokens cover at least one byte.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import written

HOT = 1 << 16
CACHE = 400_000
BATCH_CHARS = 1 << 19
LONG = 200
# Fixed value: how byte-level vocabularies part words.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the pieces seen so far."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a, self.b = tokenizers.Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letter = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on after a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # The same merges in a faster library, for short pieces: in byte-level files a token's id is its rank.
        import tiktoken

        ranks = {self.a_bytes[i]: i for t, i in vocab.items() if t not in {x.content for x in self.a.get_added_tokens_decoder().values()}}
        self.short = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.a_ids, self.b_ids = Table(), Table()
        self.spelt = np.zeros(0, bool)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece in the tables, after the new ones among them were encoded."""
        if len(self.known) > CACHE or max(self.a_ids.n, self.b_ids.n) > 16 * CACHE:
            self._forget()
        known = self.known
        if new := list(set(pieces).difference(known)):
            first = [self.short.encode_ordinary(f" {p}") if len(p) < LONG else self.a.encode(f" {p}", add_special_tokens=False).ids for p in new]
            second = self.b.encode(new, num_threads=1)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.spelt = np.concatenate([self.spelt, self._spelt([f" {p}".encode() for p in new], first, second)])
            self.a_ids.add(first)
            self.b_ids.add(second)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _spelt(self, texts: list[bytes], first: list[list[int]], second: list[list[int]]) -> np.ndarray:
        """Whether the bytes of both tokenizers' tokens are those of each text."""
        spell = lambda ids, of: b"".join(map(of.__getitem__, ids))
        sides = ((first, self.a_bytes, self.a_size), (second, self.b_bytes, self.b_size))
        whole, sizes, good = b"".join(texts), np.fromiter(map(len, texts), np.int64), True
        for ids, of, size in sides:
            n = np.fromiter(map(len, ids), np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            good = good and np.array_equal(np.bincount(np.repeat(np.arange(len(n)), n), size[flat], len(n)), sizes) and spell(flat.tolist(), of) == whole
        if good:
            return np.ones(len(texts), bool)
        return np.array([all(spell(ids[k], of) == t for ids, of, _ in sides) for k, t in enumerate(texts)])

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts by the first tokenizer and where each text's end, and the same by the second."""
        cut = [[] if not t else _CUT.split(t) if t[-1] == " " or t[0] == " " or _AFTER_SPACE.search(t) else t.split(" ") for t in texts]
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        place, doc = self.look_up(list(chain.from_iterable(cut))), np.repeat(np.arange(len(cut)), n)
        bad = np.bincount(doc, ~self.spelt[place], len(cut)) > 0
        place, doc = place[~bad[doc]], doc[~bad[doc]]
        out = []
        for table in (self.a_ids, self.b_ids):
            ids, size = table.of(place)
            out += [ids, np.cumsum(np.bincount(doc, size, len(cut))).astype(np.int64)]
        return tuple(out)


class Table:
    """Lists of ids, one after another."""

    def __init__(self) -> None:
        self.flat, self.n, self.size, self.start = np.zeros(0, np.int32), 0, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        if self.n + len(ids) > len(self.flat):
            room = np.zeros(max(1 << 16, 2 * (self.n + len(ids))), np.int32)
            room[: self.n] = self.flat[: self.n]
            self.flat = room
        self.flat[self.n : self.n + len(ids)] = ids
        self.start = np.concatenate([self.start, self.n + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        self.n += len(ids)

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at ``place``, and how many each has."""
        size = self.size[place]
        before = np.cumsum(size, dtype=np.int64) - size
        return self.flat[np.repeat(self.start[place] - before, size) + np.arange(int(size.sum()))], size


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it prints, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


class Cuts:
    """The groups of a batch's tokens, from ids of both sides and where each text's end; both sides cover the same bytes."""

    def __init__(self, both: Pair, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> None:
        self.a, self.b, self.a_ends, self.b_ends = a, b, a_ends, b_ends
        a_places, b_places = np.cumsum(both.a_size[a]), np.cumsum(both.b_size[b])
        ends = np.zeros((2, int(a_places[-1]) + 1 if len(a) else 1), bool)
        ends[0, a_places] = True
        ends[1, b_places] = True
        self.a_cut, self.b_cut = ends[1][a_places], ends[0][b_places]
        self.at_a, self.at_b = np.flatnonzero(self.a_cut), np.flatnonzero(self.b_cut)

    def links(self) -> pa.Array:
        """A list a text of ``a << 32 | b``, one for each cut."""
        links = (self.a[self.at_a].astype(np.int64) << 32) | self.b[self.at_b]
        ends = np.searchsorted(self.at_a, self.a_ends)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(links))

    def groups(self) -> pa.Array:
        """A text like ``a1,a2|b1;a3|b2,b3`` a text; empty without tokens."""
        # A token's place among all tokens in the order in which they are told, and what stands behind it.
        before_b = np.concatenate([[0], self.at_b + 1])[np.cumsum(self.a_cut) - self.a_cut]
        before_a = (self.at_a + 1)[np.cumsum(self.b_cut) - self.b_cut]
        told = np.empty(len(self.a) + len(self.b), np.int32)
        told[np.arange(len(self.a)) + before_b] = self.a * 4 + self.a_cut
        behind = self.b_cut * np.int32(2)
        behind[self.b_ends[np.diff(self.b_ends, prepend=0) > 0] - 1] = 3
        told[np.arange(len(self.b)) + before_a] = self.b * 4 + behind
        texts = _decimals(int(told.max(initial=0)) // 4).take(pa.array(told))
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(told) + 1)[np.concatenate([[0], self.a_ends + self.b_ends])] if len(told) else np.zeros(len(self.a_ends) + 1, np.int32)
        return pa.StringArray.from_buffers(len(self.a_ends), pa.py_buffer(offsets), texts.buffers()[2])


_told: list[pa.Array] = [pa.array([], pa.string())]


def _decimals(most: int) -> pa.Array:
    """Numbers up to ``most`` at least, each before a comma, a bar, a semicolon and nothing."""
    if len(_told[0]) <= 4 * most:
        _told[0] = pa.array([f"{i}{end}" for i in range(1 << most.bit_length()) for end in (",", "|", ";", "")])
    return _told[0]


def aligned(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``links`` (a list of ``a << 32 | b``) and ``groups`` (``a1,a2|b1;a3|b2,b3``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(first, second)
        for batch in batches:
            sizes = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(batch.column(1)).to_pylist()])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1), len(sizes)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    part = batch.slice(i, j - i)
                    found = Cuts(both, *both.tokens(part.column(1).to_pylist()))
                    n = [pa.array(np.diff(ends, prepend=0)) for ends in (found.a_ends, found.b_ends)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *n, found.links(), found.groups()], ["doc_id", "n_a", "n_b", "links", "groups"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, links array<bigint>, groups string")


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, its ``count``, and whether it is the highest (``best``) of its second id; from rows of ``links``."""
    counts = written(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(second).agg(F.max("count").alias("most"))  # a row an id of the second vocabulary
    joined = counts.withColumn("b", second).join(F.broadcast(most), "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))


def align(docs: DataFrame, first: str, second: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spelt = aligned(docs, first, second, id_col=id_col, text_col=text_col)
    digest = F.when(F.size("links") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = written(spelt.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "links", digest))
    counts = written(pair_counts(rows))
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * hot >= total
    each = rows.select("row", F.explode("links").alias("pair"))
    often_pairs = F.broadcast(counts.where(often))  # at most ``hot`` rows
    # One pass: a row's frequent links become sums before the shuffle, its others a row a pair.
    own = F.when(F.col("count").isNull(), F.col("pair")).alias("pair")
    sums = [F.count("*").alias("times"), F.sum("best").alias("n_best"), F.sum("count").alias("count_sum")]
    met = written(each.join(often_pairs, "pair", "left").groupBy("row", own).agg(*sums))
    frequent = met.where("pair IS NULL").select("row", "n_best", "count_sum")
    rest = met.where("pair IS NOT NULL").select("row", "pair", "times")
    rare = rest.join(counts.where(~often), "pair").select("row", (F.col("best") * F.col("times")).alias("n_best"), (F.col("count") * F.col("times")).alias("count_sum"))
    found = frequent.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    n = F.size("links").cast("bigint")
    return rows.select("row", "doc_id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), "groups_sha256").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
