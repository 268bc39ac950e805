"""Toxicity by weak supervision.

Voters say "toxic", say "clean" or abstain.  Lexicon voters hold a starting
list and words and word beginnings learnt from a bounded sample of labelled
rows (terms that toxic rows have far more often), dealt over several voters so
that one of them missing isn't decisive.  Pattern voters look at how hits are
spread (repeated, dense) and at spellings that hide a listed word (single
letters, digits for letters).  Clean voters speak where a text of some length
has no listed term, or no shouting.  A generative model estimates each
voter's rates and the correlation of voter pairs from the counts of vote
patterns over ALL documents (no label is used for that), down-weights voters
that echo one another, and gives every pattern a posterior.  A linear
classifier over hashed words and word beginnings and the votes is trained on
the posteriors of a bounded sample of all documents, half of it believed toxic
where there are so many, and scores every whole text.

Bounded, documented parameters: ``sample`` labelled rows for lexicons and
``sample`` rows for the classifier's training, whose features (not texts) reach
the driver; 2 ** (number of voters) vote patterns; 2 ** BITS weights, which
travel inside the UDF.

Defined results: null and empty texts have no votes and get the score of an
empty text; repeated rows are scored each by itself; null labels teach
nothing; without any usable label the scores are 0; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.session import written

BITS = 18
STEMS = (4, 5, 6)
GROUPS = 4
SAMPLE = 8_000
LONG = 40

# A starting lexicon: insults and slurs of everyday English.
STARTING_LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns filth vermin "
    "imbecile retard scumbag dumbass asshole bastard bitch".split()
)
TOXIC_VOTERS = ("starting", *(f"words{i}" for i in range(GROUPS)), *(f"stems{i}" for i in range(GROUPS)), "repeated", "dense", "disguised")
CLEAN_VOTERS = ("no_hit", "calm")
VOTERS = TOXIC_VOTERS + CLEAN_VOTERS
_BIT = {v: i for i, v in enumerate(VOTERS)}

_WORDS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![a-z])(?:[a-z][ .*_-]){3,}[a-z](?![a-z])")
_MIXED = re.compile(r"(?<![a-z0-9])[a-z]+[01345@$][a-z01345@$]*|(?<![a-z0-9])[01345@$][a-z01345@$]*[a-z][a-z01345@$]*")
_SHOUTED = re.compile(r"(?<!\w)[A-Z]{4,}(?!\w)")
_LETTERS = str.maketrans("01345@$", "oieasas")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@lru_cache(maxsize=50_000)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _group(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % GROUPS


def stems_of(words: Iterable[str]) -> set[str]:
    """Beginnings of longer words, of each length in STEMS."""
    return {w[:n] for w in words for n in STEMS if len(w) > n}


def disguised(text: str | None, words: frozenset) -> bool:
    """Whether a listed word is spelt in single letters or with digits for letters."""
    low = (text or "").lower()
    return any(re.sub(r"[^a-z]", "", m[0]) in words for m in _SPACED.finditer(low)) or any(m[0].translate(_LETTERS) in words for m in _MIXED.finditer(low))


def votes_of(text: str | None, words: list[str], lexicon: tuple[frozenset, frozenset]) -> int:
    """Bit mask of the voters that don't abstain."""
    lexical, stems = lexicon
    found = set(words)
    given, learnt, begun = found & STARTING_LEXICON, found & lexical, stems_of(found) & stems if stems else set()
    fired = {f"words{_group(w)}" for w in learnt} | {f"stems{_group(s)}" for s in begun}
    if given:
        fired.add("starting")
    if given or learnt or begun:
        hit = given | learnt | {w for w in found if begun and not begun.isdisjoint(stems_of((w,)))}
        hits = sum(w in hit for w in words)
        if hits >= 2:
            fired.add("repeated")
        if hits * 60 >= len(words):
            fired.add("dense")
    if disguised(text, STARTING_LEXICON | lexical):
        fired.add("disguised")
    if len(words) >= LONG and not (given or learnt or begun):
        fired.add("no_hit")
    if len(words) >= LONG and "!" not in text and not _SHOUTED.search(text):
        fired.add("calm")
    return sum(1 << _BIT[v] for v in fired)


@F.pandas_udf(T.StructType([T.StructField("mark", T.LongType()), T.StructField("more", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType()))]))
def _terms(texts: pd.Series) -> pd.DataFrame:
    """Distinct words and beginnings, and hashes that copies of a text are likely to have in common."""
    rows = []
    for text in texts:
        words = words_of(text)
        codes = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
        triples = [((a * 1_000_003 + b) * 998_244_353 + c) & 0xFFFFFFFFFFFF for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)] or [sum(codes)]
        more = [max(triples), *(min(t * odd & 0xFFFFFFFFFFFF for t in triples) for odd in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))]
        rows.append((min(triples), more, ["w" + w for w in set(words)] + ["s" + w for w in stems_of(words)]))
    return pd.DataFrame(rows, columns=["mark", "more", "terms"])


def learn_lexicons(taught: DataFrame, least: int = 6, least_stems: int = 4, share: float = 0.008, ratio: float = 40.0) -> tuple[frozenset, frozenset]:
    """Words and beginnings that mark toxic rows of (text, label).

    A term counts if ``share`` of the toxic rows (``least`` or ``least_stems`` of them at least)
    have it and this is ``ratio`` times its share of other rows.  Copies of a
    row count once: of rows with one smallest hash of three words, only the first does, and a term counts as often as
    the rows that have it differ in each of four more such hashes.
    Terms are counted in Spark; only those that count are collected.  Beginnings are learnt from toxic rows without a
    listed word.
    """
    each = taught.select("label", F.xxhash64("text").alias("h"), _terms("text").alias("t")).select("label", "h", "t.*")
    rows = written(each.groupBy("label", "mark").agg(F.min_by("terms", "h").alias("terms"), F.min_by("more", "h").alias("more")))
    def marking(of: DataFrame, kind: str, least: int) -> frozenset:
        size = {r["label"]: r["count"] for r in of.groupBy("label").count().collect()}
        bad, clean = F.least(*(F.countDistinct(F.when(F.col("label") == 1, F.col("more")[i])) for i in range(4))), F.sum(1 - F.col("label"))
        counted = of.select("label", "more", F.explode("terms").alias("term")).where(F.col("term").startswith(kind)).groupBy("term").agg(bad.alias("bad"), clean.alias("clean"))
        far = (F.col("bad") + 0.5) / (size.get(1, 0) + 1) >= ratio * (F.col("clean") + 0.5) / (size.get(0, 0) + 1)
        return frozenset(r.term for r in counted.where((F.col("bad") >= max(least, share * size.get(1, 0))) & far).select("term").collect())

    words = marking(rows, "w", least)
    # Beginnings are for what listed words miss: those of the words themselves would find other words that begin so.
    listed = F.array(*(F.lit(w) for w in sorted(words | {"w" + w for w in STARTING_LEXICON})))
    stems = marking(rows.where((F.col("label") == 0) | ~F.arrays_overlap("terms", listed)), "s", least_stems)
    return frozenset(t[1:] for t in words), frozenset(t[1:] for t in stems)


def label_model(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, np.ndarray]:
    """Posterior of each vote pattern; per voter the rates of voting under either class; pair correlations.

    EM over a two-class model in which a voter votes with one rate on toxic and
    another on clean rows.  Correlations are a part of the model: given the
    classes, the residual correlation of each pair is measured anew in every
    round, and a vote's weight is divided by 1 + the sum of its positive ones with
    the votes for the same class beside it, so that echoes count once; silence
    is discounted alike, and says nothing where it is a clean voter's.
    """
    m, n_toxic = len(VOTERS), len(TOXIC_VOTERS)
    masks = np.array(sorted(patterns), np.int64)
    count = np.array([patterns[k] for k in masks.tolist()], float)
    fired = ((masks[:, None] >> np.arange(m)) & 1).astype(float)
    q = np.clip(fired[:, :n_toxic].sum(1) / 3.0, 0.01, 0.99)
    begin = np.array([[0.02] * n_toxic + [1.0] * (m - n_toxic), [1.0] * n_toxic + [0.2] * (m - n_toxic)])
    toxic = np.arange(m) < n_toxic
    allied = toxic[:, None] == toxic[None, :]
    share, rate, corr = np.ones(m), np.zeros((2, m)), np.zeros((m, m))
    for step in range(rounds):
        w = np.stack([count * (1 - q), count * q])
        new = (w @ fired + begin) / (w.sum(1, keepdims=True) + 2.0)
        new[1, toxic] = np.maximum(new[1], new[0] * 1.5)[toxic]  # a voter speaks for its class
        new[0, ~toxic] = np.maximum(new[0], new[1] * 1.5)[~toxic]
        new = np.clip(new, 1e-5, 1 - 1e-3)
        prior = float(np.clip((count * q).sum() / count.sum(), 1e-4, 0.5))
        if step >= 5:
            resid, var = np.zeros((m, m)), np.zeros(m)
            for c in (0, 1):
                d = fired - new[c]
                resid += (d * w[c][:, None]).T @ d
                var += (w[c][:, None] * d * d).sum(0)
            fresh = np.where(allied, resid / np.sqrt(np.outer(var, var) + 1e-12), 0)
            np.fill_diagonal(fresh, 0)
            corr = 0.5 * corr + 0.5 * fresh
            share = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        alone = 1 / (1 + fired @ np.clip(corr, 0, 1))  # a vote is discounted by the echoes that are there
        on, off = np.log(new[1] / new[0]), np.log((1 - new[1]) / (1 - new[0])) * share
        off[~toxic] = 0  # short texts have no clean voter: its silence says nothing
        odds = np.log(prior / (1 - prior)) + (fired * alone) @ on + (1 - fired) @ off
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - rate).max() < 1e-9 and step > 20:
            break
        rate = new
    return dict(zip(masks.tolist(), q.tolist(), strict=True)), rate, corr


def features_of(words: list[str]) -> np.ndarray:
    """Slots of the distinct words and their beginnings (of the middle length)."""
    found, n = set(words), STEMS[1]
    names = found | {"~" + w[:n] for w in found if len(w) > n}
    return np.unique(np.fromiter((_slot(x) for x in names), np.int32, len(names)))


def train_linear(rows: list[tuple[np.ndarray, int, float]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels (AdaGrad, one row at a time, in a seeded order).

    A row's word part is scaled by the root of its size, votes stand by themselves.
    """
    m = len(VOTERS)
    w, v, b = np.zeros(1 << BITS), np.zeros(m), -2.0
    gw, gv, gb = np.full(1 << BITS, 1.0), np.full(m, 1.0), 1.0
    order = np.random.default_rng(7)
    bits = np.arange(m)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, mask, target = rows[i]
            scale = 1 / np.sqrt(len(slots) + 1)
            fired = ((mask >> bits) & 1).astype(float)
            z = w[slots].sum() * scale + fired @ v + b
            g = 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - target
            if abs(g) < 1e-4:
                continue
            d = g * scale
            gw[slots] += d * d
            w[slots] -= rate * (d + decay * w[slots]) / np.sqrt(gw[slots])
            dv = g * fired
            gv += dv * dv
            v -= rate * dv / np.sqrt(gv)
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    return w, v, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE):
    """UDFs of a text column, (score, votes), fitted on all of ``docs`` and the usable labels; None without both labels.

    ``learn_from`` is a condition on doc_id that labelled rows must meet to be
    used.  Texts are read for the lexicons' sample, for the votes on all rows
    and for the features of the sample that trains the classifier.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(learn_from & F.col("label").isin(0, 1))
    # Half of the sample is toxic where that many are: a bounded set of ids, so it may be broadcast.
    parts = [usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    taught = written(base.join(ids, "doc_id").select("text", "label"))
    if taught.select("label").distinct().count() < 2:
        return None
    lexicon = learn_lexicons(taught)

    @F.pandas_udf("long")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series([votes_of(t, words_of(t), lexicon) for t in texts], dtype="int64")

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(words_of(t)) for t in texts])

    voted = written(base.select(F.xxhash64("text").alias("h"), vote("text").alias("votes")))
    patterns = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}
    belief, _, _ = label_model(patterns)
    toxic = [k for k, q in belief.items() if q >= 0.5]
    halves = [voted.where(c).select("h", "votes").distinct().orderBy(F.xxhash64("h"), "h").limit(sample // 2) for c in (F.col("votes").isin(toxic), ~F.col("votes").isin(toxic))]
    drawn = F.broadcast(halves[0].unionByName(halves[1]))
    chosen = base.withColumn("h", F.xxhash64("text")).join(drawn, "h").groupBy("h").agg(F.first("text").alias("text"), F.first("votes").alias("votes"))
    got = chosen.select("h", "votes", features("text").alias("slots")).orderBy("h").toLocalIterator()
    rows = [(np.array(r.slots, np.int32), r.votes, belief[r.votes]) for r in got]
    w, v, b = train_linear(rows)
    del rows
    w32, bits = w.astype(np.float32), np.arange(len(VOTERS))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            words = words_of(t)
            mask = votes_of(t, words, lexicon)
            slots = features_of(words)
            z = float(w32[slots].sum()) / np.sqrt(len(slots) + 1) + float(((mask >> bits) & 1) @ v) + b
            out[i] = 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))
        return pd.Series(out)

    return score, vote


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of each row of ``docs``; options are those of ``fit_toxicity``."""
    fitted = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    score = fitted[0](F.col(text_col).cast("string")) if fitted else F.lit(0.0)
    scored = docs.select(F.col(id_col).alias("doc_id"), score.alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
