"""Streaming encoding, alignment of tokenizers and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from loomstead.llm import bpe_stream, queries, resampling, token_align

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "'", "s", "re", "'s", "ll", "a", "e", "th", "the", "in", "ing", " ", "  ", "\n", "\t", "\x1c", "!", "1", "23", "é", "é", "Σ", "İ", "<|endoftext|>", "<|end", "oftext|>",
    "<|", "́", "漢", "ü", "가", "가", "　", " ", "x", "<s>", "<0x41>", "😀", "�",
]


def odd_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return bpe_stream.model(WORDS)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORDS)


def fed(machine, text, step):
    return [i for at in range(0, len(text), step) for i in machine.feed(text[at : at + step])] + machine.finish()


def test_encoding_of_odd_texts(model, library):
    model.learn(odd_texts(300, 1))
    for n, text in enumerate(odd_texts(1200, 2)):
        want = library.encode(text, add_special_tokens=False).ids
        assert fed(bpe_stream.Encoder(model), text, 1 + n % 7) == want, text
        assert fed(bpe_stream.Transducer(model), text, 1 + n % 5) == want, text
        decoder = bpe_stream.Decoder(model)
        assert decoder.feed(want[:3]) + decoder.feed(want[3:]) + decoder.finish() == library.decode(want, skip_special_tokens=False)


def test_words_at_once(model):
    model.learn(odd_texts(3000, 3))
    assert len(model.pieces) > 1000
    for piece, ids in list(model.pieces.items()):
        assert list(ids) == model.piece(piece)


@pytest.mark.parametrize("word", ["ab" * 20000, "e" * 20001, "!?" * 9000 + "'s", "é" * 15000, "<|endoftext|>" * 900, "á" * 6000])
def test_long_words_hold_little(model, library, word):
    slow, got, most = bpe_stream.Transducer(model), [], 0
    for at in range(0, len(word), 1000):
        got += slow.feed(word[at : at + 1000])
        most = max(most, len(slow.parts) + len(slow.raw) + len(slow.text))
    assert got + slow.finish() == library.encode(word, add_special_tokens=False).ids
    assert most < bpe_stream.LONG + model.merges.lookahead + 8000
    assert fed(bpe_stream.Encoder(model), f"x {word} y", 777) == library.encode(f"x {word} y", add_special_tokens=False).ids


def test_lookahead_suffices():
    """Random merge lists: ids that end beyond the lookahead do not change, whatever follows."""
    rng = random.Random(7)
    for _ in range(150):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        m = bpe_stream.Merges(merges)
        ahead = m.lookahead
        for _ in range(60):
            head = [rng.choice("abc") for _ in range(rng.randint(1, 3 * ahead + 4))]
            far = [rng.choice("abc") for _ in range(rng.randint(0, 2 * ahead + 4))]
            stable, at = [], 0
            for t in m.merge(head):
                if at + len(t) >= len(head) - ahead:
                    break
                stable.append(t)
                at += len(t)
            whole = m.merge(head + far)
            assert whole[: len(stable)] == stable
            assert m._merge_few(head + far) == m._merge_many(head + far)


def test_lists_out_of_order_are_refused():
    with pytest.raises(ValueError, match="before it is made"):
        bpe_stream.Merges([("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError, match="two rules"):
        bpe_stream.Merges([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_plain_decoding_parts_characters(model, library):
    text = "naïve café 漢字 😀"
    ids = library.encode(text, add_special_tokens=False).ids
    machine = bpe_stream.Decoder(model, plain=True)
    assert "".join([*(machine.feed([i]) for i in ids), machine.finish()]).split() == text.split()
    assert bpe_stream.Decoder(model, plain=True).feed([ids[0]]).strip() in text
    half = next(i for i, b in enumerate(bpe_stream._plain_bytes(model)) if b == b"\xe6")
    broken = bpe_stream.Decoder(model, plain=True)
    assert broken.feed([half]) == "" and broken.finish() == "�"


def test_op11(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    more = [(None, "two words"), (-1, None), (-2, ""), (-3, "again"), (-3, "again"), (-4, "long" * 40000), (-5, " \n ")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x")})
    got = [tuple(r) for r in bpe_stream.round_trip_digests(docs, WORDS).collect()]
    want = []
    for doc, text in rows + more:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((doc, len(ids), *sums))
    assert sorted(got, key=str) == sorted(want, key=str)
    both = bpe_stream.decode(bpe_stream.encode(docs.drop("ids"), WORDS), WORDS).select("text", "ids", "decoded").collect()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in both)
    assert bpe_stream.round_trip_digests(docs.limit(0), WORDS).collect() == []


def brute_alignment(rows):
    a = tokenizers.Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letter = {c: i for i, c in enumerate(token_align.byte_letters())}
    names = {i: t for t, i in a.get_vocab().items()}
    a_bytes = lambda i: bytes(map(letter.__getitem__, names[i]))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for doc, text in rows:
        ids = [a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [list(map(a_bytes, ids[0])), list(map(b_bytes, ids[1]))]
        if any(b"".join(p) != f" {text}".encode() for p in parts):
            ids, parts = [[], []], [[], []]
        ends = [list(np.cumsum([len(x) for x in p])) for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids[0][ends[0].index(c)], ids[1][ends[1].index(c)]) for c in cuts]
        groups = [[[i for i, e in zip(ids[k], ends[k], strict=True) if before < e <= c] for k in (0, 1)] for before, c in zip([0, *cuts], cuts, strict=False)]
        text_of = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((doc, len(ids[0]), len(ids[1]), links, hashlib.sha256(text_of.encode()).hexdigest() if cuts else ""))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(d, x, y, len(k), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), s) for d, x, y, k, s in out]


@pytest.mark.parametrize("hot", [token_align.HOT, 30, 1])
def test_op12(spark, hot):
    rows = list(enumerate(odd_texts(600, 5, 25)))
    rows += [(-1, None), (-2, ""), (-3, " "), (-4, "  "), (-5, "a▁b"), (-6, "\x00a"), (-7, "a "), (-8, "x" * 5000), (-9, " a"), (-9, " a"), (None, "the end"), (-10, "the " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "links": F.lit("x"), "pair": F.lit(2)})
    got = [tuple(r) for r in token_align.align(docs, BYTES, PIECES, hot=hot).collect()]
    assert sorted(got, key=str) == sorted(brute_alignment(rows), key=str)
    assert token_align.align(docs.limit(0), BYTES, PIECES).collect() == []


def test_op12_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, token_align.align(docs, BYTES, PIECES).collect())) == sorted(brute_alignment(rows))
    assert queries.op12_token_align(spark, SF).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op12_groups_and_links(spark):
    rows = list(enumerate(odd_texts(200, 9, 25))) + [(900, None), (901, ""), (902, "a▁b"), (903, "the end")]
    got = token_align.aligned(spark.createDataFrame(rows, "n long, t string"), BYTES, PIECES, id_col="n", text_col="t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "mapInArrow" in plan.replace("MapInArrow", "mapInArrow") and "lambda" not in plan  # no expression of the JVM walks the tokens
    want = {r[0]: r for r in brute_alignment(rows)}
    for r in got.collect():
        assert (r.n_a, r.n_b, len(r.links)) == want[r.doc_id][1:4]
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.links else r.groups) == want[r.doc_id][7]
        cuts = [[side.split(",")[-1] for side in g.split("|")] for g in r.groups.split(";")] if r.groups else []
        assert r.links == [int(a) << 32 | int(b) for a, b in cuts]


def brute_resampling(docs, target, longest=1, percent=10, least=20):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    raw, wanted = Counter(b for _, t in docs for b in runs(t)[1]), Counter(b for t in target for b in runs(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    out = []
    for doc, text in docs:
        n, found = runs(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple([*r[:4], r[4] if type(r[4]) is int else None]) for r in out]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 60), (1, 100)])
def test_op13(spark, longest, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "Some WORDS and more " * 9), (-1, None), (-2, ""), (-3, "Ünï 12 " * 30), (-3, "Ünï 12 " * 30), (-4, "!? " * 99)]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "n_words": F.lit(0), "rank": F.lit(1)})
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resample(docs, wanted, longest=longest, percent=percent).collect()]
    assert sorted(got, key=str) == sorted(brute_resampling(rows, target, longest, percent), key=str)


def test_op13_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    got = resampling.resample(docs, docs.limit(0)).collect()
    assert len(got) == 2 and all(r["rank"] is None for r in got)
    assert resampling.resample(docs.limit(0), docs).collect() == []
