"""Memory tables derived from the driver's tables.

Each is a list of expressions over one table, in SQL that Spark and other
engines read alike, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

DERIVED: dict[str, tuple[str, list[str], str]] = {
    "points": (
        "embeddings",
        [
            "vec_id AS seq",
            "concat('p', CAST(vec_id AS STRING)) AS id",
            "concat('u', CAST(vec_id % 3 AS STRING)) AS user_id",
            "concat('fact ', CAST(vec_id % 180 AS STRING)) AS data",
            "md5(concat('fact ', CAST(vec_id % 180 AS STRING))) AS hash",
            "CASE WHEN label % 4 = 3 THEN NULL ELSE concat('lane', CAST(label % 4 AS STRING)) END AS lane",
            "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE concat('persona', CAST(vec_id % 2 AS STRING)) END AS persona",
            "CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 7 = 1 THEN NULL ELSE concat('proj', CAST(vec_id % 7 AS STRING)) END AS project",
            "CASE vec_id % 11 WHEN 0 THEN 'superseded' WHEN 1 THEN 'deprecated' WHEN 2 THEN 'rejected' WHEN 3 THEN 'current' END AS status",
            "CASE WHEN vec_id % 13 = 0 THEN '2024-01-15T00:00:00Z' END AS invalidated_at",
            "CASE WHEN vec_id % 11 = 0 THEN concat('p', CAST(vec_id + 11 * (vec_id % 4) AS STRING)) END AS superseded_by",
            "CASE WHEN vec_id % 11 = 0 THEN concat('2024-01-', lpad(CAST(vec_id % 28 + 1 AS STRING), 2, '0')) END AS superseded_at",
            "CASE WHEN vec_id % 6 = 0 THEN NULL ELSE concat('2024-', lpad(CAST(vec_id % 12 + 1 AS STRING), 2, '0'), '-10') END AS valid_from",
            "CASE WHEN vec_id = 42 THEN '_embedding_stamp' WHEN vec_id % 4 = 0 THEN concat('doc-', CAST(vec_id AS STRING)) END AS doc_id",
            "CASE WHEN vec_id % 8 = 0 THEN concat('Title ', CAST(vec_id AS STRING)) WHEN vec_id % 8 = 1 THEN '' END AS title",
            "CASE WHEN vec_id % 9 = 0 THEN NULL ELSE CAST(vec_id % 100 AS DOUBLE) / 100 END AS score",
            "label",
            "embedding AS vector",
        ],
        "TRUE",
    ),
    "signals": (
        "events",
        [
            "event_id",
            "ts",
            "CAST(ts AS DATE) AS day",
            "concat('surface', CAST(user_id % 4 AS STRING)) AS surface",
            "concat('proj', CAST(user_id % 3 AS STRING)) AS project",
            "CASE event_type WHEN 'view' THEN 'capture.turn' WHEN 'click' THEN 'capture.extraction' WHEN 'purchase' THEN 'capture.checkpoint' "
            "WHEN 'signup' THEN 'recall.search' ELSE 'signal.reaction' END AS event",
            "CASE event_id % 7 WHEN 0 THEN 'stored' WHEN 1 THEN 'abstained' WHEN 2 THEN 'deduped' WHEN 3 THEN 'superseded' WHEN 4 THEN 'error' "
            "WHEN 5 THEN 'failed' ELSE 'odd' END AS outcome",
            "value",
        ],
        "TRUE",
    ),
    "captures": (
        "events",
        [
            "event_id AS seq",
            "concat('c', CAST(event_id AS STRING)) AS capture_id",
            "concat('u', CAST(user_id % 50 AS STRING)) AS user_id",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('r', CAST(event_id % 4 AS STRING)) END AS run_id",
            "ts AS created_at",
            "CASE WHEN event_id % 5 = 0 THEN 'abstained' ELSE 'stored' END AS verdict",
            "concat('surface', CAST(user_id % 4 AS STRING)) AS surface",
            "concat('p', CAST(event_id % 97 AS STRING)) AS point_id",
        ],
        "event_type = 'purchase'",
    ),
    "reactions": (
        "events",
        [
            "event_id AS seq",
            "concat('m', CAST(event_id AS STRING)) AS message_id",
            "concat('u', CAST(user_id % 50 AS STRING)) AS user_id",
            "concat('r', CAST(event_id % 4 AS STRING)) AS run_id",
            "ts",
            "CAST(event_id % 4 AS BIGINT) AS n",
            "CASE event_id % 3 WHEN 0 THEN 'heart' WHEN 1 THEN 'star' ELSE 'thumb' END AS kind",
        ],
        "event_type = 'click'",
    ),
    "attached": (
        "events",
        [
            "event_id AS seq",
            "concat('c', CAST(event_id % 400 AS STRING)) AS capture_id",
            "concat('m', CAST(event_id % 900 AS STRING)) AS message_id",
            "concat('p', CAST(event_id % 60 AS STRING)) AS point_id",
            "CAST(event_id % 4 AS BIGINT) AS n",
            "CASE event_id % 3 WHEN 0 THEN 'heart' WHEN 1 THEN 'star' ELSE 'thumb' END AS kind",
        ],
        "event_type = 'error'",
    ),
    "notes": (
        "customer",
        [
            "c_custkey AS k",
            "concat('n', CAST(c_custkey AS STRING)) AS note",
            "CASE WHEN c_custkey % 11 = 0 THEN concat('gone', CAST(c_custkey AS STRING)) ELSE concat('n', CAST(c_custkey - c_custkey % 40 + c_custkey * 7 % 40 AS STRING)) END AS a",
            "CASE WHEN c_custkey % 97 = 0 THEN concat('n', CAST(c_custkey - 40 AS STRING)) WHEN c_custkey % 3 = 0 THEN concat('n', CAST(c_custkey - c_custkey % 20 + 1 AS STRING)) END AS b",
            "concat('N', CAST(c_custkey AS STRING)) AS alias",
        ],
        "TRUE",
    ),
    "turns": (
        "conversations",
        [
            "conv_id", "turn", "role", "text",
            "concat('conv', CAST(conv_id AS STRING)) AS project",
        ],
        "TRUE",
    ),
    "judged": (
        "orders",
        [
            "o_orderkey AS k",
            "o_custkey % 50 AS qid",
            "CAST(o_orderkey % 997 AS DOUBLE) / 997 AS score",
            "o_orderkey % 9 = 0 AS relevant",
            "CASE o_orderkey % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'paraphrase' ELSE 'oblique' END AS level",
            "CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE concat('lane', CAST(o_orderkey % 4 AS STRING)) END AS expected",
            "CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE concat('lane', CAST(o_orderkey % 5 % 4 AS STRING)) END AS predicted",
            "o_totalprice AS cost",
            "CAST(o_orderdate AS DATE) AS day",
        ],
        "TRUE",
    ),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = DERIVED[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*columns)


def with_sql(names: str, body: str) -> str:
    """SQL of ``body`` over the derived tables named (space-separated)."""
    parts = []
    for name in names.split():
        table, columns, where = DERIVED[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table} WHERE {where})")
    return f"WITH {', '.join(parts)} {body}" if parts else body
