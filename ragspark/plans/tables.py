"""The driver's tables as the engine's: documents, chunks, vectors, questions, messages, events; in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("dataset_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.sha2("text", 256).alias("file_hash"), F.lit("done").alias("status"), (F.coalesce("toxic", F.lit(0)) == 0).alias("enabled"), F.col("text").alias("content"),
    )


DOCS = """docs AS (SELECT d.doc_id AS document_id, CAST(substr(source, 4) AS INTEGER) AS dataset_id, concat('doc-', d.doc_id, '.txt') AS name,
 sha256(text) AS file_hash, 'done' AS status, coalesce(toxic, 0) = 0 AS enabled, text AS content FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk a document."""
    # without what only labels tell, so that texts needn't meet them
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.substring("source", 4, 9).cast("int").alias("dataset_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(True).alias("enabled"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    from ragspark.operators.structure import lines_of

    return lines_of(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "text"))


LINES = """lines AS (SELECT doc_id AS document_id, source, i - 1 AS line_no, l[i] AS line
 FROM (SELECT doc_id, source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents) x, unnest(range(1, len(l) + 1)) AS t(i))"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


TOKENS = "regexp_extract_all(lower({}), '[0-9a-z_]+|[㐀-鿿]+')"


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.col("text").alias("content"), "turn")


MESSAGES = "messages AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS id, role, text AS content, turn FROM conversations)"

#: results of an evaluation, made by arithmetic on (item_id, run); the text is valid in both dialects
RESULTS = """SELECT run, item_id AS case_id, expected_route, actual_route, expected_route = actual_route AS route_correct, route_error, retrieval_error,
 CASE WHEN route_error <> '' THEN route_error ELSE retrieval_error END AS execution_error, actual_route <> 'none' AS retrieval_performed,
 item_id % 3 <> 0 AS has_evidence, item_id % 3 = 0 AS expect_no_evidence, (item_id + run) % 2 = 0 AS no_hit, CAST((item_id + run) % 4 = 0 AS INTEGER) AS missing,
 CAST((item_id + run) % 3 = 0 AS INTEGER) * CAST(1.0 AS DOUBLE) AS hit_at_1, CAST((item_id + run) % 3 < 2 AS INTEGER) * CAST(1.0 AS DOUBLE) AS hit_at_3,
 CAST((item_id + run) % 5 < 4 AS INTEGER) * CAST(1.0 AS DOUBLE) AS hit_at_5, (item_id % 5) * CAST(0.25 AS DOUBLE) AS recall_at_5, (item_id % 3) * CAST(0.5 AS DOUBLE) AS recall_at_10,
 (run + 1) * CAST(0.25 AS DOUBLE) AS mrr_at_10, (item_id % 9) * CAST(0.125 AS DOUBLE) AS ndcg_at_10,
 CAST((item_id * 37 + run * 11) % 400 AS DOUBLE) AS route_ms, CAST((item_id * 53 + run * 29) % 900 AS DOUBLE) AS retrieval_ms,
 CAST((item_id * 37 + run * 11) % 400 + (item_id * 53 + run * 29) % 900 AS DOUBLE) AS total_ms
 FROM (SELECT item_id, run, expected_route, CASE WHEN (item_id * 7 + run * 3) % 5 = 0 THEN other ELSE expected_route END AS actual_route,
  CASE WHEN (item_id + run) % 11 = 0 THEN 'timeout' ELSE '' END AS route_error, CASE WHEN (item_id * 3 + run) % 13 = 0 THEN 'unavailable' ELSE '' END AS retrieval_error
  FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'direct' WHEN 2 THEN 'contextual_rewrite' ELSE 'decomposition' END AS expected_route,
   CASE item_id % 4 WHEN 3 THEN 'none' WHEN 0 THEN 'direct' WHEN 1 THEN 'contextual_rewrite' ELSE 'decomposition' END AS other FROM {benchmark}) b
  CROSS JOIN (SELECT 0 AS run UNION ALL SELECT 1 UNION ALL SELECT 2) r) x"""


def results(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RESULTS.format(benchmark="{b}"), b=table(spark, d, "benchmark"))


RESULTS_SQL = f"results AS ({RESULTS.format(benchmark='benchmark')})"


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").selectExpr("item_id AS case_id", "CASE item_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'direct' WHEN 2 THEN 'contextual_rewrite' ELSE 'decomposition' END AS expected_route")


CASES_SQL = "cases AS (SELECT item_id AS case_id, CASE item_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'direct' WHEN 2 THEN 'contextual_rewrite' ELSE 'decomposition' END AS expected_route FROM benchmark)"

#: ingest events out of the table of events; the text is valid in both dialects
INGEST = """SELECT event_id, user_id AS document_id, event_id % 3 + 1 AS parse_version, CAST(event_id % 5 + 1 AS INTEGER) AS attempt, ts, ts AS attempted_at,
 CASE WHEN event_type = 'error' THEN concat('failed ', CAST(event_id AS VARCHAR(20))) END AS error,
 CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'parsing' WHEN 2 THEN 'chunking' WHEN 3 THEN 'embedding' WHEN 4 THEN 'done' ELSE 'failed' END AS status,
 CASE WHEN event_type = 'error' THEN 'retryable' WHEN event_id % 10 = 0 THEN 'permanent' WHEN event_id % 10 = 1 THEN 'no_penalty' WHEN event_id % 10 = 2 THEN 'malformed' ELSE 'ok' END AS outcome
 FROM {events}"""


def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(INGEST.format(events="{e}"), e=table(spark, d, "events"))


INGEST_SQL = f"ingest AS ({INGEST.format(events='events')})"
