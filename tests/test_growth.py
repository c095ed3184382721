"""What must not grow with the tables: rows that tasks hand on, batches in Python, exchanges of texts."""

import pyarrow as pa
from pyspark.sql import functions as F

from ragspark.functions.text import search_tokens, terms_of
from ragspark.operators import embedding, retrieval


def test_terms_in_python_and_spark(spark):
    texts = ["A_b c-9 Straße K İx", "中文ab字 㐀鿿、x", "", None, "é中", "\x00a\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", search_tokens(F.col("text")).alias("t")).collect()
    assert {r.id: r.t or [] for r in rows} == {i: terms_of(t) for i, t in enumerate(texts)}


def test_a_task_hands_on_its_best_only(spark):
    pairs = [(q, t) for q in (7, 8) for t in ("a", "b", f"c{q}")]
    texts = ["a " * (i % 13) + ("b c7" if i % 5 else "") for i in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 2500)), pa.array(texts[lo : lo + 2500])], ["chunk_id", "content"]) for lo in (0, 2500)]
    out = list(retrieval._best(pairs, 10, "query_id", pa.int64())(iter(batches)))
    assert sum(map(len, out)) == 20
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    queries = spark.createDataFrame([(7, "a b c7"), (8, "b a c8"), (9, "none of it"), (10, "")], "query_id int, query string")
    got = retrieval.search_chunks(chunks, queries).collect()
    assert sorted(got) == sorted(retrieval.fulltext_topk(retrieval.postings(chunks), queries).collect()) and len(got) == 20


def test_embedding_in_small_batches(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("word"), F.col("id") % 7, F.lit(" 中文")).alias("text")).coalesce(1)
    got = embedding.hashed_embedding(rows, "id", F.col("text"), 8)
    assert got.where(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0).count() == 3000
    assert "flatten" not in got._jdf.queryExecution().optimizedPlan().toString()  # texts, not all their codes, go to Python


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_are_split_where_they_are(spark):
    from ragspark.operators import chunking

    rows = [(1, 1, "a.txt", "x " * 700), (2, 1, "b.md", "# t\n\ny"), (3, 1, "c", " "), (4, 1, None, "z"), (5, 1, "e.txt", None)]
    docs = spark.createDataFrame(rows, "document_id long, dataset_id int, name string, text string")
    got = chunking.build_chunks(docs)
    assert sorted((r.document_id, r.chunk_index) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    plain, marked = _plan(got).split("MapInArrow")[1], _plan(got)
    assert "Window" not in plain and "Join" not in plain and "Join" in marked


def test_lines_are_read_once(spark):
    from ragspark.operators import atoms as A
    from ragspark.operators import structure

    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# a", "b", "Projects", "1. c", "2. d"])], "document_id long, line_no int, line string")
    made = lines.withColumnsRenamed({"line_no": "atom_index", "line": "text"})
    for df in (A.units(A.section_atoms(A.readable(made), "paper"), sections=True), A.resume_units(made), structure.resume_sections(lines)):
        assert _plan(df).count("Relation") + _plan(df).count("LogicalRDD") == 1


def test_postings_are_not_dealt_out(spark, tmp_path):
    from ragspark.sources.index import Index

    index = Index(spark, str(tmp_path), 4)
    docs = spark.createDataFrame([(i, 1, f"b a{i} b") for i in range(50)], "document_id long, parse_version long, content string")
    index.put(docs, lambda batch: batch.selectExpr("document_id + 100 AS chunk_id", "document_id", "content"))
    files = list(tmp_path.rglob("bucket=*/*.parquet"))
    assert index.read("postings").where("tf = 2 AND term = 'b'").count() == 50
    import pyarrow.parquet as pq

    for f in files:
        terms = pq.ParquetFile(f).read(["term"]).column("term").to_pylist()
        assert terms == sorted(terms)


def test_decoding_holds_few_texts_at_once(spark):
    from ragspark.sources import files

    rows = [(i, "中é".encode(("utf-16-le", "gb18030")[i % 2])) for i in range(1500)] + [(1500, None), (1501, b"\xff\xfea")]
    docs = spark.createDataFrame([(i, raw if raw is None or i % 2 or i > 1499 else b"\xff\xfe" + raw) for i, raw in rows], "id long, content binary").coalesce(1)
    got = {r.id: r.text for r in files.decode_text(docs).collect()}
    assert got == {i: "中é" for i in range(1500)} | {1500: None, 1501: "�"}
    assert files._decoded.evalType != F.pandas_udf(lambda x: x, "string").evalType
