"""Embedding columns.  Without a model at hand, a signed feature hash of the terms; any pandas UDF can take its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark.functions.text import terms_of


def hashed_embedding(df: DataFrame, id_: str, text: Column, dim: int = 64) -> DataFrame:
    """``id_`` and embedding array<double> of each row: every term adds its sign in the place that its md5 gives.

    Rows without terms get zeros.  Nothing is shuffled.  A task works on 512 texts at a time and remembers the codes of
    terms up to a number at which it forgets all, so its memory doesn't grow with its rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes(dim)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                some = batch.slice(lo, 512)
                if len(known) > 200_000:
                    known.clear()
                cells = np.zeros(len(some) * dim)
                for i, text in enumerate(some.column("_text").to_pylist()):
                    codes = np.fromiter(map(known.__getitem__, terms_of(text)), np.int64)
                    both = np.bincount(codes, minlength=2 * dim)
                    cells[i * dim : (i + 1) * dim] = both[::2] - both[1::2]
                yield pa.RecordBatch.from_arrays([some.column(id_), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(cells))], [id_, "embedding"])

    rows = df.select(id_, text.alias("_text"))
    return rows.mapInArrow(add, rows.select(id_).schema.add("embedding", T.ArrayType(T.DoubleType())))


class _Codes(dict):
    """term -> twice its place, plus 1 where its sign is negative."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, term: str) -> int:
        digest = md5(term.encode(), usedforsecurity=False).digest()
        self[term] = code = 2 * (int.from_bytes(digest[:3], "big") % self.dim) + digest[3] % 2
        return code


def model_embedding(encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[..., Column]:
    """A pandas UDF that calls ``encode`` with at most ``batch`` texts at a time and checks that each got a vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for lo in range(0, len(texts), batch):
                some = texts.iloc[lo : lo + batch].fillna("").tolist()
                got = encode(some)
                if len(got) != len(some):
                    raise ValueError(f"{len(some)} texts, {len(got)} vectors")
                out += got
            yield pd.Series(out)

    return run
