"""The pipeline stage by stage against brute force, and queries against DuckDB."""

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_free import brute_hits, lower, shingles
from tokenizers import Tokenizer

import corpus_pipeline
from ragspark.llm import quality, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    got = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, ([r[names.index(x)] for x in df.columns] for r in got.fetchall()))) == sorted(str(list(r)) for r in df.collect())


def exact(rows):
    best = {}
    for i, t in rows.items():
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t or ""), i))
    return {i for _, i in best.values()}


def near(rows):
    sets, root = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i for i in rows if find(i) == i}


def test_stages(spark):
    """Each stage on all documents, and all of them one after another, against brute force."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    def ids(df):
        assert df.columns == docs.columns
        got = [r.doc_id for r in df.collect()]
        assert len(got) == len(set(got))
        return set(got)

    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = lambda some: {i for i, t in some.items() if not brute_hits(t, items)[1]}
    assert ids(stages["quality"](spark, docs, DATA)) == good
    assert ids(stages["exact_dedup"](spark, docs, DATA)) == exact(rows)
    assert ids(stages["near_dedup"](spark, docs, DATA)) == near(rows)
    assert ids(stages["decontamination"](spark, docs, DATA)) == clean(rows)
    left = {i: rows[i] for i in good}
    for rule in (exact, near, clean):
        left = {i: left[i] for i in rule(left)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in left.items():
        k = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, s, len(k[s : s + 1024]), zlib.crc32(k[s : s + 1024].tobytes())) for s in range(0, len(k), 1024))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(n <= 1024 for n in (sum(r.length for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}))
    assert lower("A") == "a"


def test_odd_tables(spark):
    """Columns with the names that the stages use, null texts and ids, and empty tables."""
    rows = [(1, None, 1, "a", 0.5), (2, "", 2, "b", None), (None, "some words are here", 3, None, 1.0), (3, "w " * 5000, None, "c", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, hash string, score double")
    docs = docs.withColumn("_id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("plain", F.lit(0)).withColumn("good", F.lit(False)).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        n = out.count()
        assert n <= len(rows) if name != "packing" else n >= len(rows)
        if name != "packing":
            assert out.columns == docs.columns
        if name == "exact_dedup":
            assert sorted(str(r.text)[:4] for r in out.collect()) == ["None", "some", "w w "] or n == 3
        if name in ("near_dedup", "decontamination"):
            assert n == len(rows)
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text + " more"
    rows = [(1, "one"), (1, "one"), (None, "two"), (None, "two"), (None, "t wo"), (7, text), (7, near), (None, near.replace("w", "v")), (None, text.replace("w", "v"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, docs, DATA).cache()
    assert sorted(r.text.replace(" ", "") for r in once.collect()) == sorted({t.replace(" ", "") for _, t in rows})
    left = [r.text for r in stages["near_dedup"](spark, once, DATA).collect()]
    assert len(left) == 4 and len({t.split()[0] for t in left}) == 4
