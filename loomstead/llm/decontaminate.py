"""Benchmark decontamination: a prefix-filtered set join, with DataFrame functions only.

A benchmark window is a set of positioned shingles (pairs of neighbouring
words).  A document contains the window only if it contains all of them, so a
prefix of one shingle suffices: the rarest in the global order of shingle
frequency over all documents.  Documents' shingles meet the windows' prefixes
in one join; a match at a position fixes where the window would begin, which
must lie inside the document (positional bound) and leave room for all of the
window's words (length bound); then the window's words are compared with the
document's exactly.

The window tables are broadcast where their row count, which is checked, is
at most ``BROADCAST_ROWS``; beyond it the same joins shuffle.

Defined results: a null or empty text or item has no words and no windows; an
item of fewer than ``window`` words is one window; repeated items are found
alike; rows that repeat a document (or share an id) are each judged by their
own text; null ids match null ids; other columns are ignored; an empty
benchmark leaves all documents clean, empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.session import written

WINDOW = 10
BROADCAST_ROWS = 200_000

# What separates words (ASCII without letters and digits), and the letters folded.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hash of each word with the next one; the last word, and so a lone word, has itself alone.

    Neighbours are zipped: a lambda that named ``words`` would split the text anew for every word,
    wherever the optimizer puts the expression in place of the column.
    """
    return F.zip_with(words, F.slice(words, 2, 2_000_000_000), lambda w, after: F.xxhash64(w, after))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``window_id``, their text, words, and the sorted ids of the items they occur in."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = w.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s") + 1, window).alias("words"))
    return cut.groupBy(F.array_join("words", " ").alias("needle")).agg(
        F.first("words").alias("words"), F.array_sort(F.collect_set("item_id")).alias("items"), F.count(F.lit(1)).alias("times")
    )


def _sized(df: DataFrame) -> DataFrame:
    """A written small-side table, with a broadcast hint if its size is within the bound."""
    df = written(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def prefixes(windows: DataFrame, shingled: DataFrame) -> DataFrame:
    """``token``, ``offset``, ``needle``, ``n``: the rarest shingle of each window by its count over all documents.

    A window's last word is its own shingle only in one-word windows; elsewhere
    it depends on the next word and is left out.
    """
    n = F.size("words")
    each = windows.select("needle", "words", n.alias("n"), F.posexplode(shingles_of(F.col("words"))).alias("offset", "token"))
    each = written(each.where((F.col("offset") < F.col("n") - 1) | (F.col("n") == 1)).select("needle", "n", "offset", "token"))
    vocabulary = _sized(each.select("token").distinct())
    seen = shingled.select(F.explode_outer("tokens").alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").count()
    ranked = each.join(seen, "token", "left").groupBy("needle", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("df"), "token", "offset")).alias("r"))
    return ranked.select("needle", "n", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated`` for each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = written(windows_of(items, item_col, item_text_col, window))
    lone = windows.where(F.size("words") == 1).limit(1).count() > 0
    words = words_of(F.col("text"))
    tokens = shingles_of(F.col("words"))
    if lone:  # one-word windows need every word by itself
        tokens = F.concat(tokens, F.transform(F.col("words"), lambda w: F.xxhash64(w, F.lit(None).cast("string"))))
    shingled = base.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("n_words"), tokens.alias("tokens"))
    probe = prefixes(windows, shingled)
    probe = _sized(probe.join(windows.select("needle", "items"), "needle"))
    at = shingled.select("doc_id", "n_words", F.posexplode_outer("tokens").alias("p", "token"))
    place = F.when(F.col("p") >= F.col("n_words"), F.col("p") - F.col("n_words")).otherwise(F.col("p")) if lone else F.col("p")
    found = at.join(probe, "token").withColumn("start", place - F.col("offset"))
    found = found.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    candidates = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "needle", "items")).alias("c"))
    full = base.alias("d").join(candidates.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left").select(F.col("d.doc_id").alias("doc_id"), "c", words_of(F.col("text")).alias("words"))
    exact = F.filter("c", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["n"]), " ") == c["needle"])
    hit = full.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.when(F.col("c").isNotNull(), exact).alias("hits"))
    covered = F.coalesce(F.array_size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))), F.lit(0))
    named = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"])))), F.array().cast("array<string>"))
    return hit.select("doc_id", "n_words", covered.cast("bigint").alias("n_hit"), named.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )
