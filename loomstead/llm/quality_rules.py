"""Quality rules as weak supervision.

Every rule votes good, bad or abstains on each document.  A label model (the
share of good documents and of each kind of bad ones, and in each of them
every rule's chances of its votes) is fitted by expectation-maximisation on the
counts of vote patterns, and the posterior probability of "good" replaces a
filter that wants every rule to pass.

The pattern table is bounded by 3 ** len(RULES) whatever the corpus holds, so
it is the only thing that reaches the driver.

Defined results: a null or empty text has no words, fails the base rules and
is not kept; repeated rows are judged each by itself; other columns of the
input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.session import written

MIN_WORDS = 50
REPEAT_PERCENT = 50

# Characters of the symbol count and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

# (measure, bad at or above).  These rules name a fault and abstain where it is missing.
HIGH_IS_BAD = (
    ("symbol_share", 0.10),
    ("upper_share", 0.50),
    ("repeat_share", 0.30),
    ("dup_line_share", 0.30),
    ("pipe_share", 0.08),
    ("exclaim_share", 0.20),
    ("digit_share", 0.30),
    ("odd_length_share", 0.35),
)
# (measure, bad below, good at or above); between, the rule abstains.
LOW_IS_BAD = (
    ("distinct_share", 0.08, 0.25),
    ("letter_share", 0.55, 0.75),
    ("stop_share", 0.004, 0.02),
)
RULES = tuple(r[0] for r in HIGH_IS_BAD + LOW_IS_BAD)

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = T.StructType([*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("pattern", T.StringType())])


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more in the list."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def measure(text: str | None) -> tuple:
    """Base counts of one text and its vote pattern ('+', '-' or '0' per rule)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[0x80:0xC0].sum())
    word_chars = points - int(hist[list(SPACES)].sum())
    symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    n = len(words)
    counts = (n, word_chars, symbols, dup_lines, repeats)
    if not n:
        return (*counts, "0" * len(RULES))
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    letters = upper + lower + int(hist[0xC2:0xF5].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    stops = int(hist[46] + hist[44] + hist[58] + hist[59] + hist[63])  # . , : ; ?
    m = {
        "symbol_share": symbols / word_chars,
        "upper_share": upper / max(1, upper + lower),
        "repeat_share": repeats / n,
        "dup_line_share": dup_lines / len(lines),
        "pipe_share": int(hist[124]) / n,
        "exclaim_share": int(hist[33]) / n,
        "digit_share": int(hist[48:58].sum()) / word_chars,
        "odd_length_share": float((lengths > 30).mean()),
        "distinct_share": len(set(words)) / min(n, 400),
        "letter_share": letters / word_chars,
        "stop_share": stops / n,
    }
    votes = ["-" if m[k] >= bad else "0" for k, bad in HIGH_IS_BAD]
    votes += ["-" if m[k] < bad else "+" if m[k] >= good else "0" for k, bad, good in LOW_IS_BAD]
    return (*counts, "".join(votes))


@F.pandas_udf(_SCHEMA)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[*_COUNTS, "pattern"])


# What rules that only name faults, and those that also praise, say of good documents; and a rule of the documents of its kind.
SILENT, GOOD, OWN = (0.0005, 0.999, 0.0005), (0.0005, 0.3, 0.6995), (0.8, 0.15, 0.05)
PRIOR, CORROBORATED = 20.0, 0.05


def fit_accuracies(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over "good" and one kind of bad documents for each rule: the share of every class (good first) and an array
    (class, rule, vote) of the chances that the rule votes -, 0 and + in it.

    Bad documents are of several kinds, which two classes can't hold apart.  Nothing is held fixed: priors worth
    ``PRIOR`` documents say where a kind begins (its own rule votes bad), counts decide where it ends; that good
    documents rarely have a fault is a prior worth as much as the counts.  A rule's word needs others: where the documents of a kind have, apart from its own rule's vote, the votes of good ones (a
    divergence below ``CORROBORATED``) and outnumber the prior, the rule errs on good documents, and the kind is
    taken into the good class.  With fewer documents the prior stands.
    """
    n_rules = len(RULES)
    start = np.tile(np.array([SILENT] * len(HIGH_IS_BAD) + [GOOD] * len(LOW_IS_BAD)), (n_rules + 1, 1, 1))
    for i in range(n_rules):
        start[i + 1, i] = OWN
    chance, share = start.copy(), np.append(0.85, np.full(n_rules, 0.15 / n_rules))
    if not patterns:
        return share, chance
    votes = np.array([["-0+".index(c) for c in p] for p, _ in patterns])
    counts = np.array([n for _, n in patterns], float)
    hot = np.eye(3)[votes]  # pattern, rule, vote
    weight = np.append(counts.sum(), np.full(n_rules, PRIOR))[:, None, None]
    merged = np.zeros(n_rules + 1, bool)
    for _ in range(2):
        for _ in range(rounds):
            w = counts * _responsibility(votes, share, chance)
            new = np.einsum("cp,prv->crv", w, hot) / np.maximum(w.sum(1), 1e-9)[:, None, None]
            faults = np.maximum(w.sum(1)[:, None, None], 1e-9) * new + weight * start
            usual = np.maximum(w.sum(1)[:, None, None], 1e-9) * new + PRIOR * start
            new = usual / usual.sum(2, keepdims=True)
            rate = (faults / faults.sum(2, keepdims=True))[..., 0]
            new = np.concatenate([rate[..., None], new[..., 1:] * ((1 - rate) / new[..., 1:].sum(2))[..., None]], axis=2)
            share = np.where(merged, 1e-12, w.sum(1) + 1)
            share /= share.sum()
            done = np.abs(new - chance).max() < 1e-8
            chance = new
            start[1:] = np.where(np.eye(n_rules)[:, :, None] > 0, start[1:], chance[0])  # but for its own rule, a kind is as the good ones until counts differ
            if done:
                break
        size = counts @ _responsibility(votes, share, chance).T
        apart = (chance * np.log(chance / chance[0])).sum(2)
        apart[np.arange(1, n_rules + 1), np.arange(n_rules)] = 0
        alone = (apart.max(1) < CORROBORATED) & (size > PRIOR)
        alone[0] = False
        if not alone.any():
            break
        merged |= alone
        for k in np.flatnonzero(alone):  # the good class starts again with the errors of this rule
            rate = size[k] / (size[0] + size[k])
            start[0, k - 1] = np.append(rate, start[0, k - 1, 1:] * (1 - rate) / start[0, k - 1, 1:].sum())
            chance[0, k - 1] = start[0, k - 1]
    return share, chance


def _responsibility(votes: np.ndarray, share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """(class, pattern): how likely each class is for rows of vote codes (0 bad, 1 abstains, 2 good)."""
    logs = np.log(share)[:, None] + np.log(chance)[:, np.arange(len(RULES)), votes].sum(-1)
    logs = np.exp(logs - logs.max(0))
    return logs / logs.sum(0)


def posterior(patterns: list[str], share: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probability of "good" for each vote pattern."""
    return _responsibility(np.array([["-0+".index(c) for c in p] for p in patterns]), share, chance)[0]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """Counts, votes, posterior and verdict for each row of ``docs``.

    Texts are read once: the narrow measures are written to the shared folder,
    pattern counts are summed on the map side, and the patterns come back with
    their posteriors as a broadcast table of at most 3 ** len(RULES) rows.
    """
    seen = written(docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col).cast("string")).alias("m")).select("doc_id", "m.*"))
    found = sorted(tuple(r) for r in seen.groupBy("pattern").count().collect())
    names = [p for p, _ in found]
    good = posterior(names, *fit_accuracies(found)).tolist() if names else []
    known = docs.sparkSession.createDataFrame(list(zip(names, good, strict=True)), "pattern string, quality_probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    probability = F.col("quality_probability")
    return seen.join(F.broadcast(known), "pattern", "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & (probability >= keep_at)).alias("kept"),
        F.col("pattern").alias("votes"), probability,
    )
