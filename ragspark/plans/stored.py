"""Queries over what is written and read again: the stored index, files of a corpus, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators import atoms as A
from ragspark.operators import chunking, evaluation
from ragspark.sources import files, sinks
from ragspark.sources.index import Index
from ragspark.sources.snapshots import Snapshots
from ragspark.streaming import ingest

from .chunks import _NAMED, _chunks, _split, _told
from .retrieval import FULLTEXT, POSTINGS, READY, TERMS, questions, ready
from .tables import DOCS, INGEST_SQL, RESULTS_SQL, documents, ingest_events, query, results, table


@query(f"WITH {READY}, {POSTINGS}, {TERMS}, {FULLTEXT} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ft")
def fulltext_stored(spark: SparkSession, d: str) -> DataFrame:
    """Postings are written by bucket of the term, those of every seventh document a second time, and searched."""
    index = Index(spark, files.scratch(spark), 16)
    chunks = ready(spark, d).withColumn("parse_version", F.lit(1))
    build = lambda batch: batch.select("chunk_id", "document_id", "content")
    index.put(chunks, build)
    index.put(chunks.where("document_id % 7 = 0"), build)
    return index.fulltext_topk(questions(spark, d)).withColumn("score", F.round("score", 6))


#: what comes in three batches: (batch, rows, version)
_BATCHES = [(1, "document_id % 5 <> 4", "1 + CAST(document_id % 3 = 0 AS INTEGER)"), (2, "document_id % 3 < 2", "1"), (3, "document_id % 4 = 0 OR document_id % 5 = 4", "2")]
_ARRIVED = " UNION ALL ".join(f"SELECT {b} AS batch, document_id, {v} AS version FROM docs WHERE {rows}" for b, rows, v in _BATCHES)


@query(
    f"""WITH RECURSIVE {_NAMED}, arrived AS ({_ARRIVED}), best AS (SELECT document_id, max(version) AS version, arg_max(batch, (version, batch)) AS batch FROM arrived GROUP BY 1),
 src AS (SELECT document_id AS key, concat('batch ', batch, chr(10), chr(10), content) AS text FROM best JOIN docs USING (document_id)), {_split("src", "pieces")},
 made AS (SELECT key AS document_id, 0 AS o, piece_index AS i, piece AS content, piece AS embed, 'text' AS element_type, 0 AS page, '' AS parser_name, '' AS image_key FROM pieces), {_chunks("made")}"""
)
def ingest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after three batches of documents, some of which come late with a version below the stored one."""
    index = Index(spark, files.scratch(spark), 16)
    docs = documents(spark, d)
    for b, rows, version in _BATCHES:
        batch = docs.where(rows).withColumn("parse_version", F.expr(version).cast("long")).withColumn("text", F.concat(F.lit(f"batch {b}\n\n"), "content"))
        index.put(batch, chunking.build_chunks)
    return _told(index.read("chunks"))


@query(f"WITH {DOCS}, h AS (SELECT document_id, dataset_id, CASE WHEN document_id % 9 = 0 THEN '' ELSE file_hash END AS file_hash FROM docs) SELECT document_id, CASE WHEN file_hash = '' THEN document_id ELSE arg_min(document_id, (document_id % 3, document_id)) OVER (PARTITION BY dataset_id, file_hash) END AS registered_id FROM h")
def register_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Uploads in a stream of three files, by document_id % 3: each is held against the stored ones before it."""
    at = files.scratch(spark)
    store = Snapshots(spark, f"{at}/store")
    rows = documents(spark, d).select("document_id", "dataset_id", F.when(F.col("document_id") % 9 == 0, "").otherwise(F.col("file_hash")).alias("file_hash"))
    for k in range(3):
        rows.where(F.col("document_id") % 3 == k).write.mode("append").parquet(f"{at}/uploads")
        ingest.register_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/uploads"), store, f"{at}/checkpoint").start().awaitTermination()
    return store.read("uploads").select("document_id", "registered_id")


def _streamed(stream: DataFrame, at: str) -> DataFrame:
    """What a stream of files gives, run to its end."""
    spark = stream.sparkSession
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)  # what keyed state needs; a stream takes it over when it starts
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(
    f"""WITH RECURSIVE {INGEST_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY event_id) AS n FROM ingest),
 st AS (SELECT document_id, n, event_id, parse_version AS version, status, attempt, TRUE AS acted FROM e WHERE n = 1 UNION ALL
  SELECT document_id, n, event_id, CASE WHEN acts THEN v ELSE version END, CASE WHEN acts THEN s ELSE status END, CASE WHEN NOT acts THEN attempt WHEN v > version THEN a ELSE greatest(attempt, a) END, acts FROM
   (SELECT st.document_id, e.n, e.event_id, st.version, st.status, st.attempt, e.parse_version AS v, e.status AS s, e.attempt AS a, e.parse_version > st.version OR (e.parse_version = st.version AND st.status NOT IN ('done', 'cancelled') AND NOT (st.status = 'cancelling' AND e.status <> 'cancelled')) AS acts
    FROM st JOIN e ON e.document_id = st.document_id AND e.n = st.n + 1))
 SELECT document_id, event_id, status, CASE status WHEN 'parsing' THEN 10 WHEN 'chunking' THEN 40 WHEN 'embedding' THEN 60 WHEN 'done' THEN 100 ELSE 0 END::INTEGER AS progress FROM st WHERE acted"""
)
def status_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream: keyed state tells which act on their document."""
    at = files.scratch(spark)
    ingest_events(spark, d).select("document_id", "event_id", "parse_version", "attempt", "status").write.parquet(f"{at}/in")
    events = spark.readStream.schema("document_id long, event_id long, parse_version long, attempt int, status string").parquet(f"{at}/in")
    return _streamed(ingest.status_timeline(events), at)


@query(f"WITH {DOCS} SELECT DISTINCT dataset_id, CASE WHEN document_id % 9 = 0 THEN '' ELSE file_hash END AS file_hash, CASE WHEN document_id % 9 = 0 THEN document_id END AS alone FROM docs")
def dedupe_stream(spark: SparkSession, d: str) -> DataFrame:
    """Uploads as a stream within one watermark; those without a hash are told apart by their id."""
    at = files.scratch(spark)
    rows = documents(spark, d).select("document_id", "dataset_id", F.when(F.col("document_id") % 9 == 0, "").otherwise(F.col("file_hash")).alias("file_hash"), F.timestamp_seconds(F.col("document_id") + 1).alias("ts"))
    rows.write.parquet(f"{at}/in")
    kept = _streamed(ingest.dedupe_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), within="365 days"), at)
    return kept.select("dataset_id", "file_hash", F.when(F.col("file_hash") == "", F.col("document_id")).alias("alone"))


_FILE = "string_agg(replace(replace(text, chr(13), ' '), chr(10), ' '), chr(10) ORDER BY doc_id) || chr(10)"


@query(f"SELECT source, 'txt' AS extension, strlen({_FILE}) AS size, sha256({_FILE}) AS file_hash, length({_FILE}) AS n_chars FROM documents GROUP BY 1")
def read_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as text files, one for each source with a line a document, and read as a corpus."""
    at = files.scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", F.translate("text", "\r\n", "  ").alias("line"))
    # one file a source: a source's lines are sorted where they are, the number of sources is small
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "line").write.partitionBy("source").text(at)
    good, _ = files.read_corpus(spark, at, glob="*.txt")
    return good.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "extension", "size", "file_hash", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH {RESULTS_SQL} SELECT 'results' AS what, count(*) AS n, sum(case_id)::BIGINT AS cases FROM results UNION ALL SELECT 'failures', count(*), sum(case_id)::BIGINT FROM results WHERE execution_error <> '' OR NOT route_correct OR missing > 0 OR (expect_no_evidence AND NOT no_hit) UNION ALL SELECT 'summary', count(DISTINCT expected_route), 0 FROM results")
def write_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of an evaluation, read again."""
    at = files.scratch(spark)
    r = results(spark, d)
    sinks.write_report(r, r.groupBy("expected_route").count(), evaluation.failed_cases(r), at)
    told = lambda what, df, n: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), n.alias("cases"))
    out = told("results", spark.read.json(f"{at}/results"), F.sum("case_id"))
    out = out.unionByName(told("failures", spark.read.json(f"{at}/failures"), F.sum("case_id")))
    return out.unionByName(told("summary", spark.read.parquet(f"{at}/summary"), F.lit(0).cast("long")))


@query(f"""WITH {DOCS} SELECT document_id, CASE WHEN document_id % 4 = 1 THEN 'a scan needs a vision model' ELSE 'an image needs a vision model' END AS reason FROM docs WHERE document_id % 4 IN (1, 2)""")
def failed_documents(spark: SparkSession, d: str) -> DataFrame:
    """By document_id % 4: text, a scanned page beside text, an image alone, and an image alone that was described."""
    k = F.col("document_id") % 4
    one = documents(spark, d).select("document_id", F.lit(0).alias("atom_index"), F.when(k == 0, F.col("content")).otherwise("").alias("text"), F.when(k != 0, "i.png").alias("image_key"), (k == 1).alias("need_vision"), F.when(k == 3, F.col("content")).alias("description"))
    more = one.where(F.col("document_id") % 4 == 1).withColumns({"atom_index": F.lit(1), "text": F.lit("text"), "image_key": F.lit(None).cast("string"), "need_vision": F.lit(False)})
    return A.failed_documents(one.unionByName(more))
