"""Benchmark decontamination by winnowing (operator 5).

A text's fingerprints are the hashes of its k-grams that are the smallest in some run of w consecutive k-grams.  Two
texts that share k + w - 1 words share such a run, so they share a fingerprint: with k = 5 and w = 6 no shared passage of
10 words is missed.  Documents' fingerprints are joined with those of the benchmark; each hit is extended to the windows
of 10 words around it, and these are joined with the benchmark's windows.  Windows are the same when 128 bits of hash are.
An item of n < 10 words is a window of its own, found with k and w that add up to n + 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, cut, grams, mix, signed, table, text_slices, words

def winnow(h: np.ndarray, row: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints among words ``h``; ``row`` tells texts apart.  Of equal hashes in a run the rightmost counts."""
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    best = np.arange(n) + w - 1
    low = g[w - 1 : w - 1 + n].copy()
    for j in range(w - 2, -1, -1):
        x = g[j : j + n]
        less = x < low
        low[less] = x[less]
        best[less] = np.flatnonzero(less) + j
    whole = row[: n] == row[k + w - 2 : k + w - 2 + n]
    at = np.unique(best[whole])
    return at, g[at]


def _rows_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def parameters(length: int) -> tuple[int, int]:
    """k and w for windows of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def grams_at(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``k`` words from each of some places on."""
    a, b = np.full(len(starts), k, np.uint64), np.full(len(starts), k + 1, np.uint64)
    for j in range(k):
        a = a * np.uint64(0x5851F42D4C957F2D) + h[starts + j]
        b = (b ^ mix(h[starts + j] + np.uint64(j))) * np.uint64(0xD6E8FEB86659FD93)
    return mix(a), mix(b)


def _in(table_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(x), bool)
    i = np.searchsorted(table_, x)
    i[i == len(table_)] = 0
    return table_[i] == x


def _item_windows(longest: int):  # noqa: ANN202
    """The windows of each item with the fingerprints of the whole: rows of a fingerprint (p) or of a window (a, b)."""
    names = ["item", "length", "p", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column("text")):
                h, _, _, counts = words(data, offsets, ALNUM)
                row = _rows_of(counts)
                size = np.minimum(counts, longest)
                for n in map(int, np.unique(size[size > 0])):
                    mine = size[row] == n
                    x, own = h[mine], row[mine]
                    _, g = winnow(x, own, *parameters(n))
                    g = np.unique(g)
                    none = lambda k: pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([none(len(g)), pa.array(np.full(len(g), n, np.int32)), signed(g), none(len(g)), none(len(g))], names)
                    starts = np.arange(len(x) - n + 1)
                    starts = starts[own[starts] == own[starts + n - 1]]
                    a, b = grams_at(x, starts, n)
                    ids = batch.column("item_id").take(pa.array(lo + own[starts]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(starts), n, np.int32)), none(len(starts)), signed(a), signed(b)], names)

    return run


_HITS = "_key long, doc_id long, _text long, n_words long, length int, p long, first array<int>, a array<long>, b array<long>"


def _fingerprints(shared: object, lengths: list[int]):  # noqa: ANN202
    """A row for each document, and one for each of its fingerprints with the windows around it: their first words and hashes.

    ``shared``: for each length the benchmark's fingerprints, sorted, if these are few enough to be told to all tasks; only
    those go on then.
    """
    names = [x.split()[0] for x in _HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                h, _, _, counts = words(data, offsets, ALNUM)
                row = _rows_of(counts)
                none = lambda kind, n=hi - lo: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key")[lo:hi], batch.column("doc_id")[lo:hi], batch.column("_text")[lo:hi], pa.array(counts), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int32())), none(pa.list_(pa.int64())), none(pa.list_(pa.int64()))], names
                )
                first = np.append(0, np.cumsum(counts))
                for n in lengths:
                    k, w = parameters(n)
                    at, g = winnow(h, row, k, w)
                    if known is not None:
                        on = _in(known[n], g)
                        at, g = at[on], g[on]
                    for part in range(0, len(at), 1 << 15):
                        x, p = at[part : part + (1 << 15)], g[part : part + (1 << 15)]
                        starts = x[:, None] - np.arange(w)[None, :]
                        good = (starts >= 0) & (starts + n <= len(h))
                        good[good] = row[starts[good]] == row[starts[good] + n - 1]
                        good &= row[np.maximum(starts, 0)] == row[x][:, None]
                        a, b = grams_at(h, starts[good], n)
                        ends = np.append(0, np.cumsum(good.sum(1))).astype(np.int32)
                        place = (starts - first[row[x]][:, None])[good].astype(np.int32)
                        m = len(x)
                        nulls = pa.nulls(m, pa.int64())
                        lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (pa.array(place), signed(a), signed(b))]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row[x]]), nulls, nulls, nulls, pa.array(np.full(m, n, np.int32)), signed(p), *lists], names)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of hit words out of sorted, distinct first words and lengths (``at``: first * 16 + length)."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for at in batch.column("at"):
            x = at.values.to_numpy()
            first = x >> 4
            end = np.maximum.accumulate(first + (x & 15))
            new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
            out.append([{"first": a, "end": b} for a, b in zip(first[new].tolist(), end[np.append(new[1:], len(x)) - 1].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, kind), batch.column("items"), batch.column("n_items")], ["_key", "hits", "items", "n_items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = 1_000_000, longest: int = 10) -> DataFrame:
    """What each document shares with the benchmark; one row for each input row.

    docs: doc_id, text; benchmark: item_id, text.  Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    ``hits`` (runs of hit words, struct(first, end)), ``items`` (item ids) and text_hash (xxhash64 of the text).  Null and empty texts have no words.
    Items without words match nothing; rows that repeat an item_id are one item, and so are those without one: they hit
    words and count as an item, but have no place in ``items``.  Null and repeated doc_ids are kept as they come.  Other
    columns are ignored.  An empty benchmark contaminates nothing.

    ``most``: fingerprints, windows or hits up to which they are broadcast; more of them are joined by shuffle, with
    the same results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    told = cut(items.mapInArrow(_item_windows(longest), "item long, length int, p long, a long, b long"))
    prints = told.where("p is not null").select("length", "p").distinct()
    windows = told.where("p is null").groupBy("length", "a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    lengths = sorted(r.length for r in told.select("length").distinct().collect())  # at most ``longest``
    few = prints.count() <= most
    shared = None
    if few:
        got = prints.toArrow()
        of, p = got.column("length").to_numpy(), got.column("p").to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast({n: np.sort(p[of == n]) for n in lengths})
    found = cut(docs.mapInArrow(_fingerprints(shared, lengths), _HITS))
    near = found.where("n_words is null")
    if not few:
        near = near.join(prints, ["length", "p"], "left_semi")
    near = near.select("_key", "length", F.explode(F.arrays_zip("first", "a", "b")).alias("x")).select("_key", "length", "x.first", "x.a", "x.b").distinct()
    if told.count() <= most:
        windows = F.broadcast(windows)
    at = (F.col("first").cast("long") * 16 + F.col("length")).alias("at")
    hits = cut(near.join(windows, ["length", "a", "b"]).select("_key", at, "items", "unnamed"))
    of_doc = hits.groupBy("_key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    named = hits.select("_key", F.explode("items").alias("item")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    unnamed = hits.groupBy("_key").agg(F.max("unnamed").alias("unnamed"))
    both = of_doc.join(unnamed, "_key").join(named, "_key", "left")
    none = F.expr("cast(array() as array<bigint>)")
    both = both.select("_key", "at", F.coalesce("items", none).alias("items"), (F.coalesce(F.size("items"), F.lit(0)) + F.col("unnamed")).cast("long").alias("n_items"))
    both = cut(both.mapInArrow(_runs, "_key long, hits array<struct<first:long,end:long>>, items array<long>, n_items long"), [hits])
    if both.count() <= most:
        both = F.broadcast(both)
    out = found.where("n_words is not null").select("_key", "doc_id", "_text", "n_words").join(both, "_key", "left")
    out = out.withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)"))).withColumn("items", F.coalesce("items", none))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), "hits", "items", F.col("_text").alias("text_hash"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "items", "text_hash")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS win
            FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
     ns AS (SELECT DISTINCT n FROM iw),
     dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(s)),
     hit AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
     pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
