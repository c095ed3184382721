"""Exact nearest vectors with pruning: vectors in cells around pivots, of which those that can't matter are passed over.

A vector belongs to the pivot at the smallest angle, and blocks of a cell are shells: vectors from one angle to another.
As angles obey the triangle inequality, no vector of a shell [lo, hi] around p is nearer to a query q than
max(lo - angle(q, p), angle(q, p) - hi).  A query first searches the cell of its own nearest pivot; the k-th similarity it
finds there bounds what it still needs, and of all other blocks only those that could have it are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import DEFAULT_K, DEFAULT_SCORE, SENT, ranked

_BLOCK = "dim int, cell int, lo double, hi double, ids array<long>, flat array<double>"
#: what rounding may add to an angle
_SLACK = 1e-6


@dataclass
class Cells:
    """``blocks`` (dim, cell, lo, hi, ids, flat), which may be stored by cell, and the pivots of each dimension."""

    blocks: DataFrame
    pivots: dict[int, np.ndarray]


def _unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length made norm 1, and which have a norm."""
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(v, axis=1)
    return v / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` vectors of each length that has at least 64 for each, chosen by a hash; lengths with fewer have one pivot, their first axis."""
    counts = {r.dim: r.n for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    out = {dim: np.eye(1, dim) for dim in counts}
    for dim, rows in counts.items():
        if rows >= 64 * n:
            rate = int(2**31 * min(1.0, 4 * n / rows))
            some = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(2**31)) < rate)).select("id", "embedding").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(n)
            p, fine = _unit(pa.array([r.embedding for r in some.collect()], pa.list_(pa.float64())), dim)
            if fine.any():
                out[dim] = p[fine]
    return out


def vector_cells(vectors: DataFrame, n: int = 64, block: int = 1024) -> Cells:
    """Cells of vectors (chunk_id, embedding) around ``n`` pivots, in blocks of up to ``block``.  Vectors of norm 0 are left out.

    Vectors are dealt by range of cell and angle, so a cell of any size lies in many tasks.
    """
    rows = vectors.where("embedding IS NOT NULL AND chunk_id IS NOT NULL AND size(embedding) > 0").select(F.col("chunk_id").cast("long").alias("id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding"))
    pivots = _pivots(rows, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                v, fine = _unit(some.column("embedding"), int(dim))
                angle = _angles(v, pivots[int(dim)])
                cell = angle.argmin(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(dim)), pa.array(v.ravel()))
                out = pa.RecordBatch.from_arrays([some.column("dim"), pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(v)), cell]), some.column("id"), flat], ["dim", "cell", "angle", "id", "v"])
                yield out.filter(pa.array(fine))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            ends = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cells) != 0)) + 1
            angle, ids = batch.column("angle").to_numpy(), batch.column("id")
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(batch)], strict=True):
                for a in range(lo, hi, block):
                    b = min(hi, a + block)
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array(dims[a : a + 1]), pa.array(cells[a : a + 1]), pa.array(angle[a : a + 1]), pa.array(angle[b - 1 : b]), one(ids.slice(a, b - a)), one(batch.column("v").slice(a, b - a).flatten())], ["dim", "cell", "lo", "hi", "ids", "flat"])

    order = ["dim", "cell", "angle", "id"]
    placed = rows.mapInArrow(assign, "dim int, cell int, angle double, id long, v array<double>")
    return Cells(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(gather, _BLOCK), pivots)


def _search(pivots: dict[int, np.ndarray], k: int, key: str, counted: bool = False):  # noqa: ANN202
    """Rows of (block, queries with their bounds) -> the best ``k`` of each query that the block could better; or how many could be and were passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                at = lambda c, i=i: batch.column(c)[i]
                dim, cell, lo, hi = (at(c).as_py() for c in ("dim", "cell", "lo", "hi"))
                ids, flat, q_ids, q_flat, bound = (at(c).values.to_numpy() for c in ("ids", "flat", "q_ids", "q_flat", "bound"))
                q = q_flat.reshape(-1, dim)
                angle = _angles(q, pivots[dim][cell : cell + 1])[:, 0]
                near = np.maximum(0, np.maximum(lo - angle, angle - hi) - _SLACK)
                could = np.cos(np.minimum(near, np.pi)) >= bound - 1e-9
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([len(could)]), pa.array([int(could.sum())])], ["pairs", "met"])
                    continue
                if not could.any():
                    continue
                q_ids, s = q_ids[could], np.round(q[could] @ flat.reshape(-1, dim).T, 9)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                fits = best >= bound[could][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[fits.ravel()]), pa.array(ids[order][fits]), pa.array(best[fits])], [key, "chunk_id", "score"])

    return run


def _queries(cells: Cells, queries: DataFrame, key: str) -> DataFrame:
    """Queries with norm: id, dim, v, and the cell of their nearest pivot."""
    pivots = cells.pivots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(np.unique(dims).tolist()) & set(pivots):
                some = batch.filter(pa.array(dims == dim))
                v, fine = _unit(some.column("embedding"), dim)
                cell = _angles(v, pivots[dim]).argmin(axis=1).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(dim)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("dim"), pa.array(cell), flat], ["id", "dim", "cell", "v"]).filter(pa.array(fine))

    rows = queries.where(f"embedding IS NOT NULL AND {key} IS NOT NULL AND size(embedding) > 0").select(F.col(key).cast("long").alias("id"), F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(place, "id long, dim int, cell int, v array<double>")


def _together(queries: DataFrame, by: list[str]) -> DataFrame:
    """Queries (id, v, bound) of equal ``by`` in one row: q_ids, q_flat, bound."""
    rows = F.array_sort(F.collect_list(F.struct("id", "bound", "v")))
    got = queries.groupBy(*by).agg(rows.alias("r"))
    return got.select(*by, F.transform("r", lambda x: x["id"]).alias("q_ids"), F.flatten(F.transform("r", lambda x: x["v"])).alias("q_flat"), F.transform("r", lambda x: x["bound"]).alias("bound"))


def _bounded(cells: Cells, queries: DataFrame, k: int, min_score: float | None, key: str, most: int) -> DataFrame:
    """Query rows for all blocks: dim, turn, q_ids, q_flat, and the similarity that each query has ``k`` of in its own cell, -1 (or ``min_score``) without."""
    least = F.lit(-1.0 if min_score is None else float(min_score))
    q = _queries(cells, queries, key)
    turn = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-q.count() // most)))).cast("int")
    mine = _together(q.withColumn("bound", least).withColumn("turn", turn), ["dim", "cell", "turn"])
    own = cells.blocks.join(F.broadcast(mine), ["dim", "cell"]).mapInArrow(_search(cells.pivots, k, key), f"{key} long, chunk_id long, score double")
    bounds = ranked(own, key, k).where(F.col("rank") == k).select(F.col(key).alias("id"), F.col("score").alias("_b"))
    return _together(q.join(bounds, "id", "left").withColumn("bound", F.greatest(least, F.coalesce("_b", least))).withColumn("turn", turn), ["dim", "turn"])


def pruned_topk(cells: Cells, queries: DataFrame, k: int = DEFAULT_K, min_score: float | None = DEFAULT_SCORE, key: str = "query_id", block: int = 256) -> DataFrame:
    """As :func:`ragspark.operators.retrieval.vector_topk`, with blocks passed over that can't hold any of a query's ``k`` nearest.

    Queries are gathered in rows of about ``block`` and broadcast, which their size must allow (``SENT`` bytes).
    """
    size = queries.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))).first()[0]
    if size > SENT:
        raise ValueError(f"{size} bytes of queries; search in turns of {SENT}")
    asked = _bounded(cells, queries, k, min_score, key, block)
    found = cells.blocks.join(F.broadcast(asked), "dim").mapInArrow(_search(cells.pivots, k, key), f"{key} long, chunk_id long, score double")
    top = ranked(found, key, k)
    return top.where(F.col("score") >= min_score) if min_score is not None else top


def pruning(cells: Cells, queries: DataFrame, k: int = DEFAULT_K, min_score: float | None = DEFAULT_SCORE, key: str = "query_id", block: int = 256) -> DataFrame:
    """pairs of queries and blocks, and how many of them are met, in one row."""
    asked = _bounded(cells, queries, k, min_score, key, block)
    found = cells.blocks.join(F.broadcast(asked), "dim").mapInArrow(_search(cells.pivots, k, key, counted=True), "pairs long, met long")
    return found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"))
