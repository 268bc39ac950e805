"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded by surface measures and hashed word shapes and endings; a small gated
attention network, trained on document labels alone, weighs the passages, and
the document's score is read from the weighted passage representation.

Training uses a documented bound of ``sample`` labelled rows; their encoded
passages reach the driver, everything else stays in Spark tasks.

Defined results: null and empty texts are one empty passage; repeated rows are
scored each by itself; null labels teach nothing; where both labels don't
occur the scores are 0.5; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_WORDS = 128
HASHED = 32
HIDDEN = 16
SAMPLE = 4_000

MEASURES = (
    "symbols", "upper", "digits", "pipes", "exclaims", "stops", "distinct", "bigram_repeat", "line_breaks", "mean_length", "long_words", "marks", "size", "repeat_run"
)
DIM = len(MEASURES) + HASHED


@lru_cache(maxsize=100_000)
def _word_slot(word: bytes) -> int:
    """Hash of a word's shape (case, letter, digit, mark) with its last letters."""
    shape = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else c for c in word[-6:])
    return zlib.crc32(shape) % HASHED


def encode_passage(words: list[bytes], raw: bytes) -> np.ndarray:
    out = np.zeros(DIM)
    n = len(words)
    if not n:
        return out
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw) - int(hist[32] + hist[10] + hist[9]))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    pairs = list(zip(words, words[1:], strict=False))
    out[: len(MEASURES)] = (
        int(hist[list(b"#*$%&<>")].sum()) / size * 5,
        upper / max(1, upper + lower) * 2,
        int(hist[48:58].sum()) / size * 3,
        int(hist[124]) / n * 3,
        int(hist[33]) / n * 2,
        int(hist[46] + hist[44]) / n * 4,
        len(set(words)) / n,
        1 - len(set(pairs)) / max(1, len(pairs)),
        int(hist[10]) / n * 4,
        min(len(raw) / n, 20) / 10,
        sum(len(w) > 20 for w in words) / n,
        int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / size * 3,
        n / PASSAGE_WORDS,
        sum(a == b for a, b in pairs) / n * 2,
    )
    slots = np.bincount([_word_slot(w) for w in words], minlength=HASHED)
    out[len(MEASURES) :] = np.sqrt(slots / n)
    return out


def encode(text: str | None) -> np.ndarray:
    """All passages of a whole text, one row each."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if len(words) <= PASSAGE_WORDS:
        return encode_passage(words, raw)[None]
    out = []
    at = 0
    for a in range(0, len(words), PASSAGE_WORDS):
        some = words[a : a + PASSAGE_WORDS]
        start = at
        for w in some:
            at = raw.index(w, at) + len(w)
        out.append(encode_passage(some, raw[start:at]))
    return np.stack(out)


class GatedAttention:
    """h = tanh(W x); a = softmax over passages of u . (tanh(V h) * sigmoid(G h)); score = sigmoid(c . sum(a h) + b)."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: rng.normal(0, 1 / np.sqrt(s[-1]), s)
        self.p = {
            "W": make(HIDDEN, DIM), "w": np.zeros(HIDDEN), "V": make(HIDDEN, HIDDEN), "G": make(HIDDEN, HIDDEN),
            "u": make(HIDDEN), "c": make(HIDDEN), "b": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"].T + p["w"])
        t = np.tanh(h @ p["V"].T)
        g = 1 / (1 + np.exp(-(h @ p["G"].T)))
        e = (t * g) @ p["u"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return sizes, h, t, g, a, z, y

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)[-1]

    def gradients(self, x: np.ndarray, starts: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        sizes, h, t, g, a, z, y = self.forward(x, starts)
        d = (y - target) * weight / len(target)
        dz = np.repeat(d[:, None] * p["c"], sizes, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dtg = de[:, None] * p["u"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"] + dg @ p["G"]) * (1 - h * h)
        return {"W": dh.T @ x, "w": dh.sum(0), "V": dt.T @ h, "G": dg.T @ h, "u": (de[:, None] * t * g).sum(0), "c": d @ z, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], target: np.ndarray, epochs: int = 40, rate: float = 0.01, batch: int = 64) -> GatedAttention:
        """Adam over shuffled batches; classes weigh alike."""
        rng = np.random.default_rng(5)
        ones = target.mean()
        weight = np.where(target == 1, 0.5 / ones, 0.5 / (1 - ones))
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                some = [bags[i] for i in pick]
                starts = np.cumsum([0, *map(len, some[:-1])])
                step += 1
                for k, grad in self.gradients(np.concatenate(some), starts, target[pick], weight[pick]).items():
                    grad = grad + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


@F.pandas_udf(T.ArrayType(T.FloatType()))
def encoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode(t).astype(np.float32).ravel(), na_action=None)


def mil_quality(
    docs: DataFrame, labels: DataFrame, *, learn_from, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, sample: int = SAMPLE,
) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (score >= threshold) for each row of ``docs``.

    ``learn_from`` is a condition on doc_id that labelled rows must meet.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(learn_from & F.col("label").isin(0, 1))
    parts = [usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (0, 1)]
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    bags, target = [], []
    for r in base.join(ids, "doc_id").select("doc_id", "label", encoded("text").alias("x")).orderBy("doc_id", "label").toLocalIterator():
        bags.append(np.array(r.x, np.float64).reshape(-1, DIM))
        target.append(r.label)
    if len(set(target)) < 2:
        return base.select("doc_id", F.lit(0.5).alias("score"), F.lit(0).alias("predicted"))
    model = GatedAttention().fit(bags, np.array(target, float))
    del bags

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            some = texts.iloc[a : a + 256]
            out[a : a + len(some)] = model.scores([encode(t) for t in some])
        return pd.Series(out)

    scored = base.select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
