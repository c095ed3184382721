"""Helpers shared by the corpus operators: written cuts of the lineage, and vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Where it is unset a local session gets one of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("ragspark.own.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="ragspark-shared-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
            spark.conf.set("ragspark.own.checkpoint.dir", where)
    return where.rstrip("/")


#: a write that is complete needs the shuffle files behind it no more
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: what is written and not yet freed: path -> session
_WRITTEN: dict[str, SparkSession] = {}


def cut(df: DataFrame, free: Sequence[DataFrame] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the lineage ends at files that all executors see.

    ``free``: cuts that nothing needs after this one; their files go.  What a result still reads stays until the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ragspark/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    for x in free:
        drop(x.cut_path)
    return out


def drop(path: str) -> None:
    """Delete the files of a cut."""
    spark = _WRITTEN.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_WRITTEN):
        try:
            drop(path)
        except Exception:  # the session has ended before  # noqa: BLE001
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


# ---------------------------------------------------------------- vectorised words

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]

#: Bytes of words that end at white space ([\x20\x09-\x0D]); in UTF-8 every byte of a longer character is over 127.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of digits, letters a-z and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs give unrelated hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text comes alone, whole.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, width, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 1 to n at least, and its inverse to the powers 0 to n; those for slices of texts are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 20)
    up = np.cumprod(np.full(size, _BASE, np.uint64))
    down = np.cumprod(np.append(np.uint64(1), np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)))
    if size == 1 << 20:
        _POWERS[:] = [up, down]
    return up, down


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, number of words by row) of all words, lower-cased in A-Z, in text order.  Words never span two rows.

    A word's hash is the difference of a running sum over bytes times powers of their places, shifted back to the word's start.
    """
    counts = np.zeros(len(offsets) - 1, np.int64)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.astype(np.uint64), none, none, counts
    inside = kind[_LOWER][data]
    edge = np.zeros(len(data), bool)
    edge[1:] = inside[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~edge)
    if not len(starts):
        return none.astype(np.uint64), none, none, counts
    edge[-1] = False
    edge[:-1] = inside[1:]
    edge[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~edge) + 1
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_LOWER_BYTE[data], up[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    return h, starts, ends, np.diff(at)


def argsort(x: np.ndarray) -> np.ndarray:
    """A stable order of numbers that are not negative.  Numbers and places are packed into 64 bits, as plain sorting is many times faster."""
    if not len(x):
        return np.zeros(0, np.int64)
    x = x.view(np.uint64) if x.dtype.itemsize == 8 else x.astype(np.uint64)
    bits = len(x).bit_length()
    mask, least = np.uint64((1 << bits) - 1), x.min()
    spare = 64 - int(x.max() - least).bit_length()
    whole = spare >= bits
    order = (x - least) << np.uint64(min(spare, 63))
    order &= ~mask
    order |= np.arange(len(x), dtype=np.uint64)
    order.sort()
    order &= mask
    order = order.view(np.int64)
    if spare > 63 or whole:
        return order
    y = x[order]
    # two hashes that differ in their last bits only
    return np.argsort(x, kind="stable") if (y[1:] < y[:-1]).any() else order


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, an order by number, the first place of each in that order)."""
    order = argsort(x)
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    first = np.flatnonzero(new)
    return y[first], order, first


class Places:
    """Places in a sorted table of hashes, which may be all from one range, looked up by their first bits over the least of them."""

    def __init__(self, table_: np.ndarray):
        self.table = table_
        self.first: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"table": self.table, "first": None}

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each of ``x``, -1 where it isn't there."""
        n = len(self.table)
        if not n or not len(x):
            return np.full(len(x), -1, np.int64)
        if self.first is None:
            bits = n.bit_length() + 1
            self.least, most = self.table[0], self.table[-1]
            self.shift = np.uint64(max(0, int(most - self.least).bit_length() - bits))
            self.slots = (most - self.least) >> self.shift
            slot = ((self.table - self.least) >> self.shift).astype(np.int64)
            self.first = np.append(0, np.cumsum(np.bincount(slot)))
            self.ended = np.append(self.table, np.uint64(2**64 - 1))
        slot = (np.maximum(x, self.least) - self.least) >> self.shift
        i = self.first[np.minimum(slot, self.slots).astype(np.int64)]
        got = self.ended[i]
        left = np.flatnonzero((got < x) & (x <= self.table[-1]))
        while len(left):
            i[left] += 1
            got[left] = self.ended[i[left]]
            left = left[got[left] < x[left]]
        i[(got != x) | (i == n)] = -1
        return i


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; the caller drops runs that span rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x5851F42D4C957F2D) + h[j : j + n]
    return mix(g)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())
