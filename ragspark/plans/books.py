"""Queries of conversations, counts, intake, schedules and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import conversation, stats
from ragspark.streaming import ingest

from .retrieval import FULLTEXT, POSTINGS, READY, TERMS, found_texts
from .tables import DOCS, INGEST_SQL, MESSAGES, chunks, documents, ingest_events, messages, query, table

# ---------------------------------------------------------------- conversations


@query(
    f"""WITH {MESSAGES}, s AS (SELECT * FROM messages WHERE trim(content, ' ' || chr(10)) <> ''),
 h AS (SELECT session_id, id, list(concat(role, ':', content)) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM s)
 SELECT session_id, id, coalesce(len(h), 0)::INTEGER AS n, md5(coalesce(array_to_string(h, '|'), '')) AS digest FROM h"""
)
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    h = conversation.chat_history(messages(spark, d))
    return h.select("session_id", "id", F.size("history").alias("n"), F.md5(F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("digest"))


@query(f"WITH {MESSAGES} SELECT session_id, substr(arg_min(content, id), 1, 30) AS title FROM messages WHERE role = 'user' GROUP BY 1")
def session_titles(spark: SparkSession, d: str) -> DataFrame:
    return conversation.session_titles(messages(spark, d))


_CITED = """ans AS (SELECT id AS message_id, session_id, concat(content, ' [', turn % 3 + 1, '] [9]') AS content FROM messages WHERE role = 'assistant'),
 ah AS (SELECT message_id, n AS rank, (session_id * 7 + n) % (SELECT count(*) FROM documents) AS chunk_id, CAST(1.0 AS DOUBLE) / n AS score FROM ans, unnest(range(1, 6)) AS t(n)),
 cited AS (SELECT message_id, rank AS position, chunk_id, score FROM ah WHERE EXISTS (SELECT 1 FROM ans a WHERE a.message_id = ah.message_id AND contains(a.content, concat('[', rank, ']'))))"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Answers with markers at their end, and five hits for each by arithmetic."""
    m = messages(spark, d).where("role = 'assistant'")
    a = m.select(F.col("id").alias("message_id"), "session_id", F.concat("content", F.lit(" ["), (F.col("turn") % 3 + 1).cast("string"), F.lit("] [9]")).alias("content"))
    n_all = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_all"))
    h = a.select("message_id", "session_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")).crossJoin(F.broadcast(n_all))  # one row
    h = h.select("message_id", "rank", ((F.col("session_id") * 7 + F.col("rank")) % F.col("n_all")).alias("chunk_id"), (F.lit(1.0) / F.col("rank")).alias("score"))
    return conversation.citations(a, h)


@query(f"WITH {MESSAGES}, {_CITED} SELECT message_id, position, chunk_id, round(score, 6) AS score FROM cited")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {MESSAGES}, {DOCS}, {_CITED}, f AS (SELECT message_id, position, document_id, name, length(content) AS n FROM cited JOIN docs ON document_id = chunk_id)
 SELECT message_id, count(*)::INTEGER AS n, string_agg(concat(position, ':', document_id, ':', name, ':', n), '|' ORDER BY position, document_id) AS cited FROM f GROUP BY 1"""
)
def citation_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = conversation.citation_provenance(_cited(spark, d), chunks(spark, d), documents(spark, d).select("document_id", "name"))
    # lengths come from the chunks, to show that the join found the right rows
    size = chunks(spark, d).select("chunk_id", F.length("content").alias("n"))
    rows = p.select("message_id", F.explode("citations").alias("c")).select("message_id", "c.*").join(size, "chunk_id")
    text = F.concat_ws(":", F.col("position").cast("string"), F.col("document_id").cast("string"), "document_name", F.col("n").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "document_id", text.alias("t")))), lambda x: x["t"]), "|")
    return rows.groupBy("message_id").agg(F.count(F.lit(1)).cast("int").alias("n"), joined.alias("cited"))


_SESSIONS = """sess AS (SELECT conv_id AS session_id, conv_id % 50 AS user_id, conv_id % 30 AS dataset_id, CAST(conv_id % 2 AS INTEGER) AS status, max(turn) AS updated_at FROM conversations GROUP BY 1),
 sets AS (SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS dataset_id, source AS name FROM documents)"""


def _sessions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("updated_at"))
    s = c.select("session_id", (F.col("session_id") % 50).alias("user_id"), (F.col("session_id") % 30).alias("dataset_id"), (F.col("session_id") % 2).cast("int").alias("status"), "updated_at")
    return s, table(spark, d, "documents").select(F.substring("source", 4, 9).cast("int").alias("dataset_id"), F.col("source").alias("name")).distinct()


@query(f"WITH {_SESSIONS} SELECT session_id, sess.dataset_id, coalesce(name, '') AS dataset_name, coalesce(name, '') = '' AS dataset_deleted, updated_at FROM sess LEFT JOIN sets USING (dataset_id) WHERE status = 1")
def session_listing(spark: SparkSession, d: str) -> DataFrame:
    return conversation.session_listing(*_sessions(spark, d), status=1).select("session_id", "dataset_id", "dataset_name", "dataset_deleted", "updated_at")


@query(
    f"""WITH {MESSAGES}, {_CITED}, {_SESSIONS}, dead AS (SELECT session_id FROM sess WHERE user_id < 5)
 SELECT 'sessions' AS what, count(*) AS n FROM sess WHERE user_id >= 5 UNION ALL SELECT 'messages', count(*) FROM messages WHERE session_id NOT IN (SELECT session_id FROM dead)
 UNION ALL SELECT 'citations', count(*) FROM cited WHERE message_id // 1000 NOT IN (SELECT session_id FROM dead)"""
)
def purge_scope(spark: SparkSession, d: str) -> DataFrame:
    s, _ = _sessions(spark, d)
    left = conversation.purge_scope(s, messages(spark, d), _cited(spark, d), s.where("user_id < 5").select("user_id").distinct())
    out = None
    for what, df in left.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    f"""WITH {READY}, {POSTINGS}, {TERMS}, {FULLTEXT}, h AS (SELECT query_id, rank, document_name, content FROM ft JOIN ready USING (chunk_id)),
 p AS (SELECT query_id, string_agg(concat('[', rank, '] 文档《', document_name, '》：', chr(10), content, chr(10), chr(10)), '' ORDER BY rank) AS passages FROM h GROUP BY 1)
 SELECT item_id AS question_id, md5(CASE WHEN item_id % 5 = 0 THEN 'No documents were searched. Answer greetings, questions about this product, or from the conversation alone.' WHEN passages IS NULL THEN 'The documents hold nothing on this. Say so, and ask for more documents.'
  ELSE concat('Answer from the passages below. Mark each use with [n], its number. Say when they are not enough.', chr(10), chr(10), passages) END) AS digest FROM benchmark LEFT JOIN p ON query_id = item_id"""
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    hits = found_texts(spark, d).withColumnRenamed("query_id", "question_id")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 5 == 0, "none").otherwise("direct").alias("query_type"))
    return conversation.prompt_context(q, hits).select("question_id", F.md5("prompt").alias("digest"))


# ---------------------------------------------------------------- counts and intake


@query(f"WITH {DOCS} SELECT document_id, dataset_id, 0 AS chunk_index, md5(content) AS digest FROM docs")
def chunk_listing(spark: SparkSession, d: str) -> DataFrame:
    return stats.chunk_listing(chunks(spark, d), documents(spark, d)).select("document_id", "dataset_id", "chunk_index", F.md5("content").alias("digest"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return stats.fingerprint(table(spark, d, "documents"), "text").select("doc_id", "file_hash")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def owned_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders are documents, customers datasets, nations users; owned by those of one region."""
    docs = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("dataset_id"))
    sets = table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_nationkey").alias("user_id"))
    users = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("user_id"))
    return stats.owned_documents(docs, sets, users).select("o_orderkey", F.col("dataset_id").alias("o_custkey"))


@query("SELECT url AS image_key FROM (SELECT CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url FROM pages) x WHERE url <> ''")
def asset_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("image_key"))
    return stats.asset_keys(p)


_MODELS = "SELECT c_custkey AS dataset_id, c_nationkey AS user_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 5 END AS embed_model_id FROM {customer}"


def _models(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_MODELS.format(customer="{c}"), c=table(spark, d, "customer"))


@query(f"SELECT DISTINCT user_id FROM ({_MODELS.format(customer='customer')}) x WHERE coalesce(embed_model_id, 0) = 0")
def unbound_owners(spark: SparkSession, d: str) -> DataFrame:
    return stats.unbound_owners(_models(spark, d))


@query(f"SELECT user_id, embed_model_id, count(*) AS n FROM ({_MODELS.format(customer='customer')}) x WHERE coalesce(embed_model_id, 0) <> 0 GROUP BY 1, 2")
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    return stats.model_usage(_models(spark, d))


@query("SELECT s_suppkey AS dataset_id, coalesce(o, 0) AS documents, coalesce(l, 0) AS chunks FROM supplier LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) a ON o_custkey = s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS l FROM lineitem GROUP BY 1) b ON l_suppkey = s_suppkey")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dataset_id"))
    return stats.dataset_stats(sets, table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_id")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dataset_id")))


@query("SELECT o_orderkey AS document_id, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.document_stats(table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id")))


@query(
    f"""WITH {DOCS}, h AS (SELECT document_id, dataset_id % 4 AS dataset_id, CASE WHEN document_id % 9 = 0 THEN '' ELSE file_hash END AS file_hash FROM docs),
 r AS (SELECT document_id, CASE WHEN file_hash = '' THEN document_id ELSE min(document_id) OVER (PARTITION BY dataset_id, file_hash) END AS registered_id FROM h) SELECT *, registered_id = document_id AS is_new FROM r"""
)
def register_documents(spark: SparkSession, d: str) -> DataFrame:
    h = documents(spark, d).select("document_id", (F.col("dataset_id") % 4).alias("dataset_id"), F.when(F.col("document_id") % 9 == 0, "").otherwise(F.col("file_hash")).alias("file_hash"))
    return stats.register_documents(h).select("document_id", "registered_id", "is_new")


# ---------------------------------------------------------------- events


@query(f"WITH {INGEST_SQL} SELECT document_id, parse_version, max(attempt) AS attempt, arg_max(error, (attempted_at, event_id)) FILTER (error IS NOT NULL) AS last_error FROM ingest GROUP BY 1, 2")
def parse_attempts(spark: SparkSession, d: str) -> DataFrame:
    failed = ingest_events(spark, d)
    out = stats.parse_attempts(failed)
    last = failed.where("error IS NOT NULL").groupBy("document_id", "parse_version").agg(F.max_by("error", F.struct("attempted_at", "event_id")).alias("last_error"))
    return out.drop("last_error").join(last, ["document_id", "parse_version"], "left")


@query(
    f"""WITH {INGEST_SQL}, x AS (SELECT event_id, CASE WHEN status = 'parsing' THEN 'processing' ELSE status END AS status, ts + INTERVAL 1 HOUR AS due_at, ts + INTERVAL 2 HOUR AS lease_until FROM ingest)
 SELECT event_id FROM x WHERE (status = 'pending' AND due_at <= TIMESTAMP '2024-01-15 00:00:00') OR (status = 'processing' AND lease_until <= TIMESTAMP '2024-01-15 00:00:00')"""
)
def due_backlog(spark: SparkSession, d: str) -> DataFrame:
    e = ingest_events(spark, d).withColumn("status", F.when(F.col("status") == "parsing", "processing").otherwise(F.col("status")))
    e = e.withColumn("due_at", F.expr("ts + INTERVAL 1 HOUR")).withColumn("lease_until", F.expr("ts + INTERVAL 2 HOURS"))
    return stats.due_backlog(e, "2024-01-15 00:00:00").select("event_id")


@query(
    f"""WITH {INGEST_SQL}, x AS (SELECT event_id, ts, CASE status WHEN 'done' THEN 'published' WHEN 'failed' THEN 'dead' ELSE status END AS status FROM ingest)
 SELECT event_id, status FROM x WHERE NOT ((status = 'published' AND ts < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 168 HOUR) OR (status = 'dead' AND ts < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY))"""
)
def retention(spark: SparkSession, d: str) -> DataFrame:
    e = ingest_events(spark, d).withColumn("status", F.when(F.col("status") == "done", "published").when(F.col("status") == "failed", "dead").otherwise(F.col("status")))
    return stats.retention(e, "2024-01-25 00:00:00").select("event_id", "status")


@query(f"WITH {INGEST_SQL} SELECT event_id, CASE status WHEN 'parsing' THEN 10 WHEN 'chunking' THEN 40 WHEN 'embedding' THEN 60 + 35 * (event_id % 32) // 32 WHEN 'done' THEN 100 ELSE 0 END::INTEGER AS progress FROM ingest")
def document_progress(spark: SparkSession, d: str) -> DataFrame:
    return ingest_events(spark, d).select("event_id", T.progress(F.col("status"), F.col("event_id") % 32, F.lit(32)).alias("progress"))


@query("SELECT event_id, least(60, 2 ** (event_id % 9))::BIGINT AS wait_s, ts + to_seconds(least(60, 2 ** (event_id % 9))::BIGINT) AS next_at FROM events")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", T.backoff(F.col("event_id") % 9 + 1).alias("wait_s"))
    return e.select("event_id", "wait_s", (F.col("ts") + F.make_dt_interval(secs=F.col("wait_s"))).alias("next_at"))


@query("SELECT event_id, user_id AS document_id, event_id % 4 AS attempt, event_id % 5 <> 0 AND event_id % 4 > 0 AND event_id % 8 <> 0 AND event_id > 0 AND user_id > 0 AS good FROM events")
def parse_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    raw = e.select("event_id", "user_id", F.concat(F.lit('{"eventId":'), F.col("event_id").cast("string"), F.lit(',"documentId":'), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "").otherwise(',"parseVersion":2'), F.lit(',"attempt":'), (F.col("event_id") % 4).cast("string"), F.when(F.col("event_id") % 8 == 0, "").otherwise("}")).alias("value"))
    good, dead = ingest.parse_events(raw.withColumnRenamed("event_id", "_row"))
    a = good.select(F.col("_row").alias("event_id"), "document_id", F.col("attempt").cast("long").alias("attempt"), F.lit(True).alias("good"))
    return a.unionByName(dead.select(F.col("_row").alias("event_id"), F.col("user_id").alias("document_id"), (F.col("_row") % 4).alias("attempt"), F.lit(False).alias("good")))


@query(
    f"""WITH RECURSIVE {INGEST_SQL}, top AS (SELECT document_id, max(parse_version) AS parse_version FROM ingest GROUP BY 1),
 e AS (SELECT ingest.*, row_number() OVER (PARTITION BY document_id ORDER BY event_id) AS n FROM ingest JOIN top USING (document_id, parse_version)),
 st AS (SELECT document_id, parse_version, n, status, attempt FROM e WHERE n = 1 UNION ALL
  SELECT e.document_id, e.parse_version, e.n, CASE WHEN st.status IN ('done', 'cancelled') OR (st.status = 'cancelling' AND e.status <> 'cancelled') THEN st.status ELSE e.status END,
   CASE WHEN st.status IN ('done', 'cancelled') OR (st.status = 'cancelling' AND e.status <> 'cancelled') THEN st.attempt ELSE greatest(st.attempt, e.attempt) END
  FROM st JOIN e ON e.document_id = st.document_id AND e.n = st.n + 1)
 SELECT document_id, parse_version, arg_max(status, n) AS status, arg_max(attempt, n) AS attempt FROM st GROUP BY 1, 2"""
)
def fence_versions(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fenced_batch(ingest_events(spark, d))


@query(
    f"""WITH {INGEST_SQL}, x AS (SELECT event_id, attempt, outcome, CASE WHEN outcome = 'ok' THEN 'success' WHEN outcome IN ('permanent', 'malformed') THEN 'dead' WHEN outcome = 'no_penalty' THEN 'retry' WHEN attempt >= 5 THEN 'dead' ELSE 'retry' END AS action FROM ingest)
 SELECT event_id, action, CASE WHEN action = 'retry' THEN CASE WHEN outcome = 'no_penalty' THEN attempt ELSE attempt + 1 END END::INTEGER AS next_attempt, CASE WHEN action = 'retry' THEN least(60, 2 ** (attempt - 1))::BIGINT END AS wait_s FROM x"""
)
def route_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.route_outcomes(ingest_events(spark, d)).select("event_id", "action", "next_attempt", "wait_s")
