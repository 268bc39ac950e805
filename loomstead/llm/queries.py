"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstead.llm import (
    bpe_stream, decontaminate, html_blocks, mil_quality, mixing, ngram_join, quality_rules, resampling, suffix_dedup, surrogates, token_align,
    token_shards, toxicity,
)
from loomstead.session import ship


def _table(spark, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality_rules(spark, sf_dir: str):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark, sf_dir: str):
    import public_tokenizers

    return token_shards.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mil_quality(spark, sf_dir: str):
    scored = mil_quality.mil_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_fold(4) != 2)
    return scored.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_html_blocks(spark, sf_dir: str):
    return html_blocks.extract_main_text(_table(spark, sf_dir, "pages"))


def op5_surrogates(spark, sf_dir: str):
    return surrogates.replace_private(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir: str):
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_mixing(spark, sf_dir: str):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_join(spark, sf_dir: str):
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), links=True)


def op9_suffix_dedup(spark, sf_dir: str):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op10_toxicity(spark, sf_dir: str):
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn_from=_fold(5) != 0)
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_bpe_stream(spark, sf_dir: str):
    import public_tokenizers

    return bpe_stream.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_token_align(spark, sf_dir: str):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return token_align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op13_resampling(spark, sf_dir: str):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_shards, op3_mil_quality, op4_html_blocks, op5_surrogates, op6_decontaminate, op7_mixing, op8_ngram_join, op9_suffix_dedup,
        op10_toxicity, op11_bpe_stream, op12_token_align, op13_resampling,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLE_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

# crc32 of a word: its bytes one by one through the table of 256 remainders.
_CRC = """(SELECT list(crc ORDER BY n) AS r FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(n)))"""
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, r[1 + (xor(c, b) & 255)])), 4294967295)"""

ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
        WITH items AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM items)),
        docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
        places AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        hits AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, gram)),
        words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_ngram_join": f"""
        SELECT * FROM (WITH RECURSIVE docs AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90 GROUP BY ALL HAVING 100 * count(*) >= 90 * (max(x.n) + max(y.n) - count(*))),
        reach(doc_id, place) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.place)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links FROM sets s JOIN (SELECT doc_id, min(place) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
        LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) k USING (doc_id))""",
    "op9_suffix_dedup": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        places AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM docs WHERE length(h) >= 100)),
        starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM places) WHERE first < doc_id),
        turns AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM starts),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM turns) GROUP BY doc_id, run),
        kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM (SELECT r.*, d.h, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS before FROM runs r JOIN docs d USING (doc_id)) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op13_resampling": f"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {_ITEM_WORDS} AS w FROM documents),
        raw AS (SELECT k, unnest(w) AS word FROM docs), target AS (SELECT unnest({_ITEM_WORDS}) AS word FROM benchmark),
        places AS (SELECT word, {_CRC32} % 10000 AS bucket FROM (SELECT word FROM raw UNION SELECT word FROM target), {_CRC}),
        s AS (SELECT bucket, count(*) AS s FROM raw JOIN places USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM target JOIN places USING (word) GROUP BY bucket),
        sums AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM target) AS b),
        gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (a + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (b + 10000)))) AS BIGINT) AS gain FROM range(10000) x(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
        weights AS (SELECT k, sum(gain) AS total, count(*) AS n FROM raw JOIN places USING (word) JOIN gains USING (bucket) GROUP BY k),
        scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM docs LEFT JOIN weights USING (k)),
        noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scores),
        ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM noisy)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM ranked""",
}
