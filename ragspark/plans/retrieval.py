"""Queries of retrieval, embedding and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.functions import text as T
from ragspark.operators import cells, embedding, evaluation, retrieval
from ragspark.sources.files import scratch

from .tables import DOCS, TOKENS, chunks, documents, query, questions, table

READY = f"""{DOCS}, ready AS (SELECT document_id AS chunk_id, document_id, dataset_id, content, name AS document_name FROM docs WHERE enabled AND status = 'done')"""
POSTINGS = f"postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({TOKENS.format('content')}) AS term FROM ready) x GROUP BY 1, 2)"
TERMS = f"terms AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark)"
FULLTEXT = """ft AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
 FROM (SELECT query_id, chunk_id, sum(tf) * CAST(0.1 AS DOUBLE) AS score FROM postings JOIN terms USING (term) GROUP BY 1, 2) s) r WHERE rank <= 10)"""


def ready(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.retrieval_ready(chunks(spark, d), documents(spark, d))


@query(f"WITH {READY} SELECT chunk_id, document_name, length(content) AS n FROM ready")
def retrieval_ready(spark: SparkSession, d: str) -> DataFrame:
    return ready(spark, d).select("chunk_id", "document_name", F.length("content").cast("long").alias("n"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS x FROM documents) SELECT doc_id, len(x) AS n, array_to_string(x, ' ') AS tokens FROM t")
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("x"))
    return t.select("doc_id", F.size("x").cast("long").alias("n"), F.array_join("x", " ").alias("tokens"))


@query(f"SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))


@query(f"WITH {READY}, {POSTINGS} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS n FROM postings GROUP BY 1")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(ready(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("n"))


def _fulltext(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search_chunks(ready(spark, d), questions(spark, d))


@query(f"WITH {READY}, {POSTINGS}, {TERMS}, {FULLTEXT} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ft")
def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    return _fulltext(spark, d).withColumn("score", F.round("score", 6))


VECTORS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
 vt AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q, v) s) r WHERE rank <= 10 AND score >= 0.2)"""


@query(f"WITH {VECTORS} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM vt")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.vector_topk(v, q).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTORS} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM vt")
def vector_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same from cells around pivots, which are written by cell and of which only those that may matter are searched."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    made = cells.vector_cells(v, 16)
    at = scratch(spark)
    made.blocks.write.partitionBy("cell").parquet(at)
    stored = cells.Cells(spark.read.schema(made.blocks.schema).parquet(at), made.pivots)
    return cells.pruned_topk(stored, v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")).withColumn("score", F.round("score", 6))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_HASH = f"""tok AS (SELECT id, md5(term) AS h FROM (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents) x),
 cells AS (SELECT id, (('0x' || substr(h, 1, 6))::INTEGER) % 64 AS place, sum(CASE WHEN (('0x' || substr(h, 7, 2))::INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM tok GROUP BY 1, 2)"""


@query(f"WITH {_HASH} SELECT doc_id, count(*) FILTER (v <> 0) AS filled, round(coalesce(sum(v * v), 0), 3) AS square, round(coalesce(sum(v * (place + 1)), 0), 3) AS moment FROM documents LEFT JOIN cells ON id = doc_id GROUP BY 1")
def embed_column(spark: SparkSession, d: str) -> DataFrame:
    e = embedding.hashed_embedding(table(spark, d, "documents"), "doc_id", F.col("text"))
    add = lambda f: F.round(F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x), 3)
    return e.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("filled"), add(lambda x: x * x).alias("square"), add(lambda x, i: x * (i + 1)).alias("moment"))


_LISTS = """lists AS (SELECT query_id, 0 AS list_no, rank, chunk_id, score FROM vt UNION ALL
 SELECT vec_id, 1, n + 1, (vec_id * 7 + n * 3) % (SELECT count(*) FROM embeddings), 0.1 * n FROM embeddings, unnest(range(0, 10)) AS t(n) WHERE vec_id % 50 = 0)"""
_RRF = """SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(rrf, 9) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank
 FROM (SELECT query_id, chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 12) AS rrf, max(score) AS score FROM lists GROUP BY 1, 2) f) r WHERE rank <= 10"""


@query(f"WITH {VECTORS}, {_LISTS} {_RRF}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The vector lists, fused with a second list that arithmetic makes for each query."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    a = retrieval.vector_topk(v, q).select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id", "score")
    n = e.agg(F.count(F.lit(1)).alias("n_all"))
    b = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("n")).crossJoin(F.broadcast(n))  # one row
    b = b.select("query_id", F.lit(1).alias("list_no"), (F.col("n") + 1).alias("rank"), ((F.col("query_id") * 7 + F.col("n") * 3) % F.col("n_all")).alias("chunk_id"), (F.col("n") * F.lit(0.1)).alias("score"))
    return retrieval.rrf_fusion(a.unionByName(b)).withColumn("score", F.round("score", 6)).withColumn("rrf", F.round("rrf", 9))


#: each question as it is, and what follows its first sentence
_QS = "qs AS (SELECT item_id AS case_id, 1 AS query_no, text AS query FROM benchmark UNION ALL SELECT item_id, 2, trim(substr(text, strpos(text, '. ') + 1)) FROM benchmark WHERE strpos(text, '. ') > 0)"
_HYBRID = f"""{_QS},
 qt AS (SELECT DISTINCT case_id, query_no, unnest({TOKENS.format('query')}) AS term FROM qs),
 hft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, query_no ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT case_id, query_no, chunk_id, sum(tf) * CAST(0.1 AS DOUBLE) AS score FROM postings JOIN qt USING (term) GROUP BY 1, 2, 3) s) r WHERE rank <= 10),
 qtok AS (SELECT case_id, query_no, md5(unnest({TOKENS.format('query')})) AS h FROM qs),
 qc AS (SELECT case_id, query_no, (('0x' || substr(h, 1, 6))::INTEGER) % 64 AS place, sum(CASE WHEN (('0x' || substr(h, 7, 2))::INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM qtok GROUP BY 1, 2, 3),
 dtok AS (SELECT chunk_id, md5(unnest({TOKENS.format('content')})) AS h FROM ready),
 dc AS (SELECT chunk_id, (('0x' || substr(h, 1, 6))::INTEGER) % 64 AS place, sum(CASE WHEN (('0x' || substr(h, 7, 2))::INTEGER) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM dtok GROUP BY 1, 2),
 qn AS (SELECT case_id, query_no, sqrt(sum(v * v)) AS n FROM qc GROUP BY 1, 2), dn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM dc GROUP BY 1),
 sims AS (SELECT qn.case_id, qn.query_no, dn.chunk_id, round(coalesce(dot, 0) / (qn.n * dn.n), 9) AS score FROM qn CROSS JOIN dn
  LEFT JOIN (SELECT case_id, query_no, chunk_id, sum(qc.v * dc.v) AS dot FROM qc JOIN dc USING (place) GROUP BY 1, 2, 3) p ON p.case_id = qn.case_id AND p.query_no = qn.query_no AND p.chunk_id = dn.chunk_id
  WHERE qn.n > 0 AND dn.n > 0),
 hvt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, query_no ORDER BY score DESC, chunk_id) AS rank FROM sims) r WHERE rank <= 10 AND score >= 0.2),
 l1 AS (SELECT case_id, query_no, chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 12) AS rrf, max(score) AS score
  FROM (SELECT case_id, query_no, rank, chunk_id, score FROM hvt UNION ALL SELECT case_id, query_no, rank, chunk_id, score FROM hft) x GROUP BY 1, 2, 3),
 r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, query_no ORDER BY rrf DESC, chunk_id) AS rank FROM l1) x WHERE rank <= 10),
 l2 AS (SELECT case_id, chunk_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 12) AS rrf, max(score) AS score FROM r1 GROUP BY 1, 2),
 r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, chunk_id) AS rank FROM l2) x WHERE rank <= 10)"""


def hybrid_hits(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    at = F.instr("text", ". ")
    one = b.select(F.col("item_id").alias("case_id"), F.lit(1).alias("query_no"), F.col("text").alias("query"))
    two = b.where(at > 0).select(F.col("item_id").alias("case_id"), F.lit(2).alias("query_no"), F.trim(F.substring("text", at + 1, F.length("text"))).alias("query"))
    qs = one.unionByName(two).withColumn("query_id", F.col("case_id") * 10 + F.col("query_no"))
    docs = ready(spark, d)
    name = qs.select("query_id", "case_id", "query_no")
    ft = retrieval.search_chunks(docs, qs).join(name, "query_id")
    v = embedding.hashed_embedding(docs, "chunk_id", F.col("content"))
    qe = embedding.hashed_embedding(qs, "query_id", F.col("query"))
    vt = retrieval.vector_topk(v, qe).join(name, "query_id")
    return retrieval.hybrid_search(vt, ft)


@query(f"WITH {READY}, {POSTINGS}, {_HYBRID} SELECT case_id, rank, chunk_id, round(score, 6) AS score, round(rrf, 9) AS rrf FROM r2")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_hits(spark, d).withColumn("score", F.round("score", 6)).withColumn("rrf", F.round("rrf", 9))


_HITS = "hits AS (SELECT query_id AS case_id, rank, ft.chunk_id, document_name, content FROM ft JOIN ready USING (chunk_id))"
_EVIDENCE = """evidence AS (SELECT case_id, CAST((rank - 1) // 2 AS INTEGER) AS evidence_no, concat(' ', upper(document_name), ' ') AS document_name,
 [lower(substr(content, 1, 20)), CASE WHEN (rank + case_id) % 4 = 0 THEN 'zz none zz' ELSE substr(content, 3, 9) END] AS contains FROM hits)"""
_MATCH = """matches AS (SELECT e.case_id, e.evidence_no, h.rank, h.chunk_id FROM evidence e JOIN hits h ON h.case_id = e.case_id AND lower(trim(e.document_name)) = lower(trim(h.document_name))
 WHERE contains(lower(h.content), lower(trim(e.contains[1], ' ' || chr(10)))) AND contains(lower(h.content), lower(trim(e.contains[2], ' ' || chr(10)))))"""
_EVAL = f"WITH {READY}, {POSTINGS}, {TERMS}, {FULLTEXT}, {_HITS}, {_EVIDENCE}, {_MATCH}"


def found_texts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the full-text search with names and texts, written once for all that reads them: ten rows a question at most."""
    hits, asked = _fulltext(spark, d), questions(spark, d).count()
    if asked * retrieval.DEFAULT_K <= 1_000_000:  # else texts and hits meet by shuffle
        hits = F.broadcast(hits)
    rows = ready(spark, d).select("chunk_id", "document_name", "content").join(hits, "chunk_id")
    at = scratch(spark)
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits of the full-text search; and evidence made of them: two hits an evidence, some with a marker that no text has."""
    hits = found_texts(spark, d).withColumnRenamed("query_id", "case_id")
    second = F.when((F.col("rank") + F.col("case_id")) % 4 == 0, F.lit("zz none zz")).otherwise(F.substring("content", 3, 9))
    evidence = hits.select("case_id", F.floor((F.col("rank") - 1) / 2).cast("int").alias("evidence_no"), F.concat(F.lit(" "), F.upper("document_name"), F.lit(" ")).alias("document_name"), F.array(F.lower(F.substring("content", 1, 20)), second).alias("contains"))
    return evidence, hits


@query(f"{_EVAL} SELECT * FROM matches")
def evidence_match(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evidence_match(*_evidence(spark, d))


@query(
    f"""{_EVAL}, first AS (SELECT case_id, evidence_no, min(rank) AS r FROM matches GROUP BY 1, 2),
 gains AS (SELECT case_id, sum(1 / log2(r + 1)) AS dcg FROM (SELECT DISTINCT case_id, r FROM first WHERE r <= 10) x GROUP BY 1),
 found AS (SELECT case_id, min(r) AS best, count(*) FILTER (r <= 5) AS in5, count(*) FILTER (r <= 10) AS in10, count(*) AS matched FROM first GROUP BY 1),
 n AS (SELECT case_id, count(DISTINCT evidence_no) AS n FROM evidence GROUP BY 1)
 SELECT n.case_id, CASE WHEN best <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_1, CASE WHEN best <= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_3, CASE WHEN best <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_at_5,
  round(coalesce(in5, 0) / n, 6) AS recall_at_5, round(coalesce(in10, 0) / n, 6) AS recall_at_10, round(CASE WHEN best <= 10 THEN 1.0 / best ELSE 0.0 END, 6)::DOUBLE AS mrr_at_10,
  round(least(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 1.0), 6) AS ndcg_at_10, n - coalesce(matched, 0) AS missing
 FROM n LEFT JOIN found USING (case_id) LEFT JOIN gains USING (case_id)"""
)
def evidence_metrics(spark: SparkSession, d: str) -> DataFrame:
    evidence, hits = _evidence(spark, d)
    out = evaluation.evidence_metrics(evidence, evaluation.evidence_match(evidence, hits))
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("case_id", "missing")], "missing")


@query("SELECT item_id AS query_id, least(50, CASE WHEN item_id % 70 - 5 <= 0 THEN 10 ELSE item_id % 70 - 5 END)::INTEGER AS k, CASE WHEN item_id % 3 = 0 THEN 0.2 ELSE (item_id % 3) * 0.3 END::DOUBLE AS min_score FROM benchmark")
def retrieval_params(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), retrieval.clamp_k(F.col("item_id") % 70 - 5).alias("k"), retrieval.default_score((F.col("item_id") % 3) * F.lit(0.3)).alias("min_score"))


_RAW = "raw AS (SELECT item_id AS case_id, p AS pos, CASE p WHEN 0 THEN concat('  ', text) WHEN 1 THEN lower(text) WHEN 2 THEN ' ' WHEN 3 THEN substr(text, 5) ELSE concat(text, ' ') END AS query FROM benchmark CROSS JOIN (SELECT unnest(range(0, 5)) AS p) t)"


@query(
    f"""WITH {_RAW}, t AS (SELECT case_id, pos, trim(query, ' ' || chr(10)) AS query FROM raw),
 f AS (SELECT *, row_number() OVER (PARTITION BY case_id, lower(query) ORDER BY pos) AS n FROM t WHERE query <> '')
 SELECT case_id, query, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS query_no FROM f WHERE n = 1"""
)
def normalize_queries(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    p = F.col("pos")
    q = F.when(p == 0, F.concat(F.lit("  "), "text")).when(p == 1, F.lower("text")).when(p == 2, " ").when(p == 3, F.substring("text", F.lit(5), F.length("text"))).otherwise(F.concat("text", F.lit(" ")))
    return retrieval.normalize_queries(b.select("case_id", "pos", q.alias("query"))).select("case_id", "query", "query_no")
