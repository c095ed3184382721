"""The stored index of a collection: documents' versions, chunks, vectors and postings, always of one state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragspark.functions.text import query_terms
from ragspark.operators import retrieval

from .sinks import checked_vectors
from .snapshots import Snapshots


class Index(Snapshots):
    """Tables ``versions`` (document_id, parse_version), ``chunks``, ``vectors`` (by dim) and ``postings`` (by bucket of the term, sorted by term).

    ``buckets``: of terms; a search reads those of its terms only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        super().__init__(spark, path)
        self.buckets = self.manifest()["notes"].get("buckets", buckets)

    def _bucket(self):  # noqa: ANN202
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def acting(self, batch: DataFrame) -> DataFrame:
        """Of a batch of documents (document_id, parse_version and others) the highest version of each, unless a higher one is stored."""
        # texts are dealt out by document at most once, and not where they are so already
        order = Window.partitionBy("document_id").orderBy(F.col("parse_version").desc())
        latest = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        if "versions" not in self.manifest()["tables"]:
            return latest
        stored = self.read("versions").select("document_id", F.col("parse_version").alias("_stored"))
        return latest.join(stored, "document_id", "left").where("_stored IS NULL OR parse_version >= _stored").drop("_stored")

    def put(self, batch: DataFrame, build: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] | None = None, notes: dict | None = None) -> int:
        """Chunk a batch of documents and store it, in one commit; a version below the stored one changes nothing.

        ``build`` makes chunks (chunk_id, document_id, content and others) of documents, ``embed`` vectors (chunk_id,
        embedding) of chunks.  The same batch put again leaves the same state.
        """
        acting = self.acting(batch).persist()
        try:
            chunks = build(acting).persist()
            try:
                tables = {"versions": acting.select("document_id", F.col("parse_version").cast("long").alias("parse_version")), "chunks": chunks}
                # Postings are sorted where their chunks are and not dealt out by bucket: a bucket has a file from each task, of which
                # there are few for few chunks, and no task grows with the table
                tasks = max(self.spark.sparkContext.defaultParallelism, -(-chunks.count() // 20_000))
                posted = retrieval.postings(chunks.coalesce(tasks), ["document_id", "chunk_id"]).withColumn("bucket", self._bucket())
                tables["postings"] = posted.select("document_id", "chunk_id", "term", "tf", "bucket").sortWithinPartitions("bucket", "term")
                if embed:
                    good, _ = checked_vectors(embed(chunks))
                    tables["vectors"] = good.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id", "chunk_id", "embedding", "dim")
                return self.replace(tables, acting.select("document_id"), {"postings": ["bucket"], "vectors": ["dim"]}, (notes or {}) | {"buckets": self.buckets})
            finally:
                chunks.unpersist()
        finally:
            acting.unpersist()

    def fulltext_topk(self, queries: DataFrame, k: int = retrieval.DEFAULT_K, key: str = "query_id") -> DataFrame:
        """As :func:`ragspark.operators.retrieval.fulltext_topk`, from the stored postings: no text is read, and only the buckets of the queries' terms."""
        terms = queries.select(F.explode(query_terms(F.col("query"))).alias("term"))
        wanted = [r.b for r in terms.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        return retrieval.fulltext_topk(self.read("postings").where(F.col("bucket").isin(wanted)), queries, k, key)

    def vector_topk(self, queries: DataFrame, k: int = retrieval.DEFAULT_K, min_score: float | None = retrieval.DEFAULT_SCORE, key: str = "query_id") -> DataFrame:
        return retrieval.vector_topk(self.read("vectors"), queries, k, min_score, key)
