"""Byte-pair encoding and decoding as streams that look ahead a bounded way.

A vocabulary file with word ends (a lower-casing normaliser, a splitting
pattern, a merge list with an end-of-word suffix) is turned into a transducer:
text goes in by pieces of any length, ids come out as soon as they are stable,
and what is held does not grow with the text.

Within a word, an id is stable once it ends further from what has been read
than the merge list lets a later symbol act (``Merges.lookahead``).  Take two
texts that agree up to a place W.  Merging both in order of rank, a boundary
can first differ where a rule (s, y) is applied in one of them only, because
its right part y reaches W; that moves the difference |y| to the left at most.
The next place is the split of a rule of higher rank whose right part begins,
down its left spine, with s; the difference then moves by |s| more.  A rule
whose right part ends a word reaches W itself, so it only begins such a chain.
The longest chain, found by one walk over the merges in order of rank, is the
sufficient lookahead.  It holds for lists in which each part is made before it
is used; others are refused.

Text is cut at spaces, which no rule of the file crosses, and words are kept
in a bounded table; a stretch without spaces beyond ``LONG`` characters goes
through the transducer by small steps.  There, only a run of more than
``LONG`` combining marks is held whole (canonical order needs all of it).

Decoding is an incremental machine from bytes to text: the bytes of each id
go in, text comes out as soon as a character is whole; bytes that are no UTF-8
become U+FFFD.  Without a decoder in the file, ``decode`` writes tokens parted
by spaces; ``plain=True`` gives the words themselves.

Defined results: a null or empty text has no ids and an empty decoded text;
repeated rows are encoded each; other columns are ignored; strings of special
tokens in a text become their ids, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 1 << 16
LONG = 4096
CACHE = 300_000
SHORT = 48


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list: ranks of pairs, merging of symbols, and the sufficient lookahead in symbols."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.suffix = suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        made: dict[str, int] = {}
        for i, (left, right) in enumerate(merges):
            if made.setdefault(left + right, i) != i:
                raise ValueError("a token that two rules make has no single place in the order of merging")
        if any(made.get(part, -1) > i for i, pair in enumerate(merges) for part in pair):
            raise ValueError("a rule uses a token before it is made")
        self.size: dict[str, int] = {}
        self.lookahead = self._lookahead(merges, made)

    def _lookahead(self, merges: list[tuple[str, str]], made: dict[str, int]) -> int:
        size, reach, most = self.size, {}, 0
        for left, right in merges:
            size[left + right] = size.setdefault(left, 1) + size.setdefault(right, 1)
            far = size[right]
            if not (self.suffix and right.endswith(self.suffix)):
                part = right
                while part:
                    if part in reach:
                        far = max(far, reach[part] + size[part])
                    part = merges[made[part]][0] if part in made else ""
            reach[left] = max(reach.get(left, 0), far)
            most = max(most, far)
        return most

    def merge(self, parts: list[str]) -> list[str]:
        """The tokens of ``parts``: always the pair of lowest rank, the leftmost first."""
        return self._merge_few(parts) if len(parts) <= SHORT else self._merge_many(parts)

    def merge_all(self, words: list[bytes], code_of: np.ndarray, last_of: np.ndarray, result: np.ndarray, keys: np.ndarray) -> list[list[int]]:
        """Ids of many short words at once: in each round every word applies its pair of lowest rank.

        ``code_of`` and ``last_of`` are the ids of bytes within and at the end of a word, ``keys`` the sorted pairs of ids as
        numbers with their ranks below, ``result`` the id that each rank makes.
        """
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(n)
        sym = code_of[flat]
        sym[end - 1] = last_of[flat[end - 1]]
        word = np.repeat(np.arange(len(words)), n)
        pairs, none = keys[0], np.iinfo(np.int64).max
        out: list[list[int]] = [[]] * len(words)

        def ranked(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place."""
            after = np.minimum(at + 1, len(sym) - 1)
            want = (sym[at] << 32) | sym[after]
            found = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
            return np.where((pairs[found] == want) & (word[after] == word[at]) & (at + 1 < len(sym)), keys[1][found], none)

        rank = ranked(np.arange(len(sym)))
        while len(sym):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, start)
            sizes = np.diff(start, append=len(sym))
            done = np.repeat(least == none, sizes)
            if done.any():
                ids, ends = sym[done].tolist(), np.cumsum(sizes[least == none]).tolist()
                at = 0
                for w, e in zip(word[start[least == none]].tolist(), ends, strict=True):
                    out[w], at = ids[at:e], e
                sym, word, rank = sym[~done], word[~done], rank[~done]
                sizes, least = sizes[least != none], least[least != none]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            begins = np.diff(hit, prepend=-2) != 1
            first = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]  # a pair of equal symbols overlaps itself
            sym[hit] = result[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            again = np.unique(np.concatenate([hit, np.maximum(hit - 1, 0)]))
            rank[again] = ranked(again)
        return out

    def _merge_few(self, parts: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            left, right = parts[at], parts[at + 1]
            joined, i = parts[:at], at
            while i < len(parts):
                if parts[i] == left and i + 1 < len(parts) and parts[i + 1] == right:
                    joined.append(left + right)
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def _merge_many(self, parts: list[str]) -> list[str]:
        parts, n, rank = list(parts), len(parts), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[pair], i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (parts[i], parts[k])) in rank:
                    heapq.heappush(heap, (rank[pair], i))
            if (h := before[i]) >= 0 and (pair := (parts[h], parts[i])) in rank:
                heapq.heappush(heap, (rank[pair], h))
        return [p for p in parts if p is not None]


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters of class 0 that may compose with one before them."""
    seconds = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


@lru_cache(maxsize=1)
def _unlike() -> str:
    """A class of the characters that are letters or numbers to one of the two pattern libraries only (their Unicode
    versions differ): they are neither here, if this one has more of them, as is checked."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds = r"[\p{L}\p{N}]"
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(kinds), "removed", invert=True)
    theirs, ours = {piece for piece, _ in split.pre_tokenize_str(every)}, regex.findall(kinds, every)
    more = sorted(ord(c) for c in ours if c not in theirs)
    if len(theirs) + len(more) != len(ours):
        raise ValueError("the tokenizers library knows letters that the regex library doesn't")
    starts = [c for i, c in enumerate(more) if not i or more[i - 1] != c - 1]
    ends = [c for i, c in enumerate(more) if i + 1 == len(more) or more[i + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]" if more else ""


def _begins(c: str) -> bool:
    """Whether the normal form of a text may be taken apart before ``c``."""
    return c < "̀" or not unicodedata.combining(c) and c not in _composing()


class Model:
    """What a vocabulary file says, and the words encoded so far (a bounded table)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        if steps != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or bpe["type"] != "BPE" or spec["decoder"]:
            raise ValueError(f"{path} is not a vocabulary of lower-cased words with ends")
        self.vocab: dict[str, int] = bpe["vocab"]
        self.merges = Merges([tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in bpe["merges"]], bpe["end_of_word_suffix"] or "")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        pattern = regex.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--{_unlike()}]" if _unlike() else m[0], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words = regex.compile(pattern, regex.V1)
        self.lines = regex.compile(f"{pattern}|\n", regex.V1)
        parts = pattern.split("|")
        self.fixed = regex.compile("|".join(x for x in parts if not x.endswith("+")), regex.V1)
        self.runs = [regex.compile(x, regex.V1) for x in parts if x.endswith("+")]
        self.most_fixed = max((len(x) for x in parts if not x.endswith(("+", "]"))), default=1)
        self.fold = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])
        self.letters = _byte_letters()
        self.id_text = [""] * (max((*self.vocab.values(), *self.added.values())) + 1)
        for token, i in (*self.vocab.items(), *self.added.items()):
            self.id_text[i] = token
        self.pieces = _Pieces(self)
        self.known_words: dict[str, list[int]] = {}
        self._tables()

    def _tables(self) -> None:
        """What merging by numbers needs; only where each letter and token has an id."""
        suffix, vocab, rank = self.merges.suffix, self.vocab, self.merges.rank
        self.code_of, self.last_of = (np.array([vocab.get(c + end, -1) for c in self.letters], np.int64) for end in ("", suffix))
        self.in_bulk = min(self.code_of.min(), self.last_of.min()) >= 0 and all(a + b in vocab for a, b in rank)
        if self.in_bulk:
            pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in rank], np.int64)
            self.keys = (np.sort(pairs), np.argsort(pairs))
            self.result = np.array([vocab[a + b] for a, b in rank], np.int64)

    def learn(self, texts: list[str]) -> None:
        """Put the short pieces of these texts into the table, all at once."""
        if not self.in_bulk:
            return
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.known_words) > CACHE:
            self.known_words.clear()
        every = set(chain.from_iterable(t.replace("\n", " ").split(" ") for t in texts))
        new = [p for p in every if p not in self.pieces and len(p) <= SHORT]
        if not new:
            return
        joined = "\n".join(new)
        if self.added_pattern.search(joined):
            new = [p for p in new if not self.added_pattern.search(p)]
            joined = "\n".join(new)
        found = self.lines.findall(self.normal(joined))
        fresh = [w for w in set(found) if w != "\n" and w not in self.known_words]
        for w, ids in zip(fresh, self.merges.merge_all([w.encode() for w in fresh], self.code_of, self.last_of, self.result, self.keys), strict=True):
            self.known_words[w] = ids
        at, ids, known = 0, [], self.known_words
        for w in found:
            if w == "\n":
                self.pieces[new[at]] = ids
                at, ids = at + 1, []
            else:
                ids = ids + known[w] if ids else known[w]
        if new:
            self.pieces[new[at]] = ids

    def normal(self, text: str) -> str:
        """Composed, and each character in lower case by itself; white space is dropped later anyway."""
        if text.isascii():
            return text.lower()
        return self.fold.normalize_str(text)

    def ids_of(self, parts: list[str]) -> list[int]:
        return [i for i in map(self.vocab.get, parts) if i is not None]

    def word(self, word: str) -> list[int]:
        letters = self.letters
        parts = [letters[b] for b in word.encode()]
        parts[-1] += self.merges.suffix
        return self.ids_of(self.merges.merge(parts))

    def piece(self, text: str) -> list[int]:
        """Ids of a short text."""
        if self.added_pattern.search(text):
            out, at = [], 0
            for m in self.added_pattern.finditer(text):
                out += [*self.piece(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            return out + self.piece(text[at:])
        return [i for w in self.words.findall(self.normal(text)) for i in self.word(w)]


class _Pieces(dict):
    """Pieces of text between spaces and their ids; long ones go through the transducer and are not kept."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, text: str) -> list[int]:
        if len(text) > LONG:
            slow = Transducer(self.model)
            return [*chain.from_iterable(slow.feed(text[i : i + LONG]) for i in range(0, len(text), LONG)), *slow.finish()]
        ids = self.model.piece(text)
        if len(text) <= SHORT:
            if len(self) >= CACHE:
                self.clear()
            self[text] = ids
        return ids


class Transducer:
    """Ids of a stream without regard to spaces: holds an unfinished special token, an unfinished character
    sequence, a few characters that may become a contraction, and the unstable end of a word."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.raw = self.text = ""
        self.run: regex.Pattern | None = None
        self.parts: list[str] = []

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        self.raw += text
        while m := self.model.added_pattern.search(self.raw):
            out += [*self._normalise(self.raw[: m.start()], True), self.model.added[m[0]]]
            self.raw = self.raw[m.end() :]
        most = max(map(len, self.model.added), default=1) - 1
        keep = max((k for k in range(1, min(most, len(self.raw)) + 1) for a in self.model.added if a.startswith(self.raw[-k:])), default=0)
        cut = len(self.raw) - keep
        while cut > 0 and not (cut < len(self.raw) and _begins(self.raw[cut])):
            cut -= 1
        out += self._normalise(self.raw[:cut], False)
        self.raw = self.raw[cut:]
        return out

    def finish(self) -> list[int]:
        out = self._normalise(self.raw, True)
        self.raw = ""
        return out

    def _normalise(self, text: str, last: bool) -> list[int]:
        self.text += self.model.normal(text)
        out, at, text = [], 0, self.text
        while at < len(text):
            if self.run:
                if m := self.run.match(text, at):
                    out += self._push(m[0])
                    at = m.end()
                    continue
                out += self._close()
            if not last and len(text) - at < self.model.most_fixed:
                break
            if m := self.model.fixed.match(text, at):
                out += self.model.word(m[0])
                at = m.end()
            elif not any((run := r).match(text, at) for r in self.model.runs):
                at += 1
            else:
                self.run = run
        self.text = text[at:]
        return out + self._close() if last else out

    def _push(self, text: str) -> list[int]:
        merges, letters = self.model.merges, self.model.letters
        self.parts += [letters[b] for b in text.encode()]
        if len(self.parts) < LONG + merges.lookahead:
            return []
        tokens, end = [], 0
        for token in merges.merge(self.parts):
            if end + merges.size.get(token, 1) >= len(self.parts) - merges.lookahead:
                break
            tokens.append(token)
            end += merges.size.get(token, 1)
        self.parts = self.parts[end:]
        return self.model.ids_of(tokens)

    def _close(self) -> list[int]:
        self.run, parts, self.parts = None, self.parts, []
        if not parts:
            return []
        parts[-1] += self.model.merges.suffix
        return self.model.ids_of(self.model.merges.merge(parts))


class Encoder:
    """The stream of a whole text: pieces between spaces by table, long ones by ``Transducer``."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.held = ""
        self.long: Transducer | None = None

    def _pieces(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.model.pieces.__getitem__, text.replace("\n", " ").split(" "))))

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        text = text.replace("\n", " ")
        if self.long:
            head, space, text = text.partition(" ")
            out += self.long.feed(head)
            if not space:
                return out
            out += self.long.finish()
            self.long = None
        text = self.held + text
        cut = text.rfind(" ") + 1
        out += self._pieces(text[:cut])
        self.held = text[cut:]
        if len(self.held) > LONG:
            self.long = Transducer(self.model)
            out += self.long.feed(self.held)
            self.held = ""
        return out

    def finish(self) -> list[int]:
        out = self.long.finish() if self.long else self._pieces(self.held)
        self.held, self.long = "", None
        return out


class Decoder:
    """Text of a stream of ids.  ``plain`` gives words; otherwise tokens are parted by spaces, as the library writes
    them for a file without a decoder."""

    def __init__(self, model: Model, plain: bool = False) -> None:
        self.bytes_of = _plain_bytes(model) if plain else _token_bytes(model)
        self.trim = not plain
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if data and self.trim:
            data, self.trim = data[1:], False
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _token_bytes(model: Model) -> list[bytes]:
    """Each id's token after a space."""
    if not hasattr(model, "token_bytes"):
        model.token_bytes = [f" {t}".encode() if t else b"" for t in model.id_text]
    return model.token_bytes


def _plain_bytes(model: Model) -> list[bytes]:
    """Each id's own bytes, with a space where a word ends."""
    if not hasattr(model, "plain_bytes"):
        byte_of, suffix = {c: b for b, c in enumerate(model.letters)}, model.merges.suffix
        stem = lambda t: (t[: -len(suffix)], b" ") if suffix and t.endswith(suffix) else (t, b"")
        made = lambda t: bytes(map(byte_of.__getitem__, stem(t)[0])) + stem(t)[1]
        model.plain_bytes = [t.encode() if t in model.added else made(t) for t in model.id_text]
    return model.plain_bytes


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model a worker process: the words it has seen serve all of the worker's tasks."""
    return Model(path)


def _learned(known: Model, texts: pd.Series) -> Iterator[str]:
    """The texts, a few at a time after their words were learnt."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size > 16 * STEP:
            known.learn(held)
            yield from held
            held, size = [], 0
    known.learn(held)
    yield from held


def encoded(known: Model, text: str, step: int = STEP) -> Iterator[list[int]]:
    """Ids of ``text``, in stretches."""
    encoder = Encoder(known)
    for i in range(0, len(text), step):
        yield encoder.feed(text[i : i + step])
    yield encoder.finish()


def _digest(known: Model, numbers: list[bytes], text: str) -> tuple[int, str, str]:
    decoder, n, ids_sum, text_sum = Decoder(known), 0, hashlib.sha256(), hashlib.sha256()
    for ids in encoded(known, text):
        if ids:
            written = b"".join(map(numbers.__getitem__, ids))
            ids_sum.update(written if n else written[1:])
            text_sum.update(decoder.feed(ids).encode())
            n += len(ids)
    text_sum.update(decoder.finish().encode())
    return n, ids_sum.hexdigest(), text_sum.hexdigest()


def round_trip_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: what encoding and then decoding each text gives."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = model(path)
        numbers = [b" %d" % i for i in range(len(known.id_text))]
        for texts in batches:
            yield pd.DataFrame([_digest(known, numbers, t) for t in _learned(known, texts)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), digests(F.col(text_col).cast("string")).alias("_d")).select("doc_id", "_d.*")


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (an empty list where it is null)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model(path)
        for texts in batches:
            yield pd.Series([list(chain.from_iterable(encoded(known, t))) for t in _learned(known, texts)], index=texts.index, dtype=object)

    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded", plain: bool = False) -> DataFrame:
    """``rows`` with the text of their ids, read from the machine in stretches."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model(path)
        for lists in batches:
            out = []
            for ids in lists:
                machine, ids = Decoder(known, plain), [] if ids is None else list(ids)
                out.append("".join([*(machine.feed(ids[i : i + STEP]) for i in range(0, len(ids), STEP)), machine.finish()]))
            yield pd.Series(out, index=lists.index, dtype=object)

    return rows.withColumn(text_col, texts(F.col(ids_col)))
