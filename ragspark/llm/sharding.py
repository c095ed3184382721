"""Sharding by minimax contiguous partition (operator 2).

Equal texts form an atomic group.  Groups are ordered by a 60-bit key of their text; the smallest capacity is searched
for which greedily filled shards, cut only between groups, are enough.  The search never needs all groups at once: it
starts with the sizes of 2^``bits`` key ranges, decides every capacity that these ranges can decide, and then splits only
the ranges in which a cut may fall, until the answer is exact.  Each round collects one bounded list of ranges.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

KEY_BITS = 60


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("_key"),
    )


class Ranges:
    """Key ranges in order with their sizes; a range of one group is atomic."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)  # (first key, bits below, bytes, atomic)
        self.ends = []
        total = 0
        for _, _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def fill(self, capacity: int, shards: int, sure: bool) -> tuple[bool, list[int], list[int]]:
        """Greedy check of a capacity: whether the groups fit, where each shard ends, and the ranges inside which it is not known."""
        at, cuts, open_ = 0, [], []
        for _ in range(shards):
            k = bisect_right(self.ends, at + capacity)  # ranges that fit whole
            if k == len(self.rows):
                return True, cuts, open_
            end = self.ends[k - 1] if k else 0
            if not self.rows[k][3]:
                open_.append(k)
                if not sure:
                    end = at + capacity  # at best the cut falls at any byte of the range
            at = max(at, end)
            cuts.append(k)
        return False, cuts, open_


def _least(r: Ranges, shards: int, sure: bool, low: int, high: int) -> int:
    """Binary search of the smallest capacity that fits; with ``sure`` no open range is cut, else each may be cut anywhere."""
    while low < high:
        mid = (low + high) // 2
        if r.fill(mid, shards, sure)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(groups: DataFrame, shards: int, bits: int = 14, most: int = 1 << 16) -> tuple[int, list[int]]:
    """Smallest capacity for ``groups`` (_key, _bytes; keys distinct), and the first key of each shard after the first.

    Each round collects at most about ``most`` ranges.
    """

    def sizes(df: DataFrame, below: int) -> list[tuple[int, int, int, bool]]:
        first = F.shiftleft(F.shiftright("_key", below), below)
        got = df.groupBy(first.alias("k")).agg(F.sum("_bytes").alias("b"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()
        return [(x.lo if x.lo == x.hi else x.k, 0 if x.lo == x.hi else below, x.b, x.lo == x.hi) for x in got]

    r = Ranges(sizes(groups, KEY_BITS - bits))
    while True:
        low = max([-(-r.total // shards), *(x[2] for x in r.rows if x[3])], default=0)
        low = _least(r, shards, False, low, max(low, r.total))
        high = _least(r, shards, True, low, max(low, r.total))
        if low == high:
            return low, [r.rows[k][0] for k in r.fill(low, shards, True)[1]]
        # every range in which a cut may fall for a capacity from low to high
        unsure: set[int] = set()
        lo_at = hi_at = 0
        for _ in range(shards):
            a, b = bisect_right(r.ends, lo_at + low), bisect_right(r.ends, hi_at + high)
            unsure.update(i for i in range(a, min(b + 1, len(r.rows))) if not r.rows[i][3])
            lo_at = max(lo_at, r.ends[a - 1] if a else 0)
            hi_at = min(r.total, hi_at + high)
        # split the widest ranges first, as finely as the bound allows
        split = sorted(unsure, key=lambda i: -r.rows[i][2])[: most // 4]
        fine = max(2, (most // len(split)).bit_length() - 1)
        widths = sorted({r.rows[i][1] for i in split})
        new = [x for i, x in enumerate(r.rows) if i not in set(split)]
        for w in widths:
            firsts = [(r.rows[i][0],) for i in split if r.rows[i][1] == w]
            want = groups.sparkSession.createDataFrame(firsts, "_first long")
            inside = groups.withColumn("_first", F.shiftleft(F.shiftright("_key", w), w)).join(F.broadcast(want), "_first", "left_semi")
            new += sizes(inside, max(0, w - fine))
        r = Ranges(new)


def shard_by_bytes(docs: DataFrame, shards: int = 8, slices: int = 1024) -> DataFrame:
    """Deal ``docs`` (doc_id, text) into ``shards`` shards whose largest is as small as whole groups in key order allow.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).  A null text is empty: size 1,
    crc32 0, and equal to other empty texts.  A group never spans shards, so shards are uneven only if a group alone is
    larger than its share; then shards may stay empty.  Repeated rows each get a slot.  Null ids come first in a slice.
    Other columns are ignored.  ``slices``: parts in which the slots of one shard are counted, at most that many tasks.
    """
    rows = cut(_narrow(docs))
    groups = cut(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")))
    _, cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for k in cuts[: shards - 1]:
        shard = shard + (F.col("_key") >= F.lit(k)).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("_slice"))
    # slots: place in a slice of the shard, after all rows of the slices before it
    counts = rows.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))  # at most shards * slices rows
    place = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("_place", place).join(F.broadcast(offsets), ["shard", "_slice"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
