"""Best-fit decreasing with a segment tree over remaining capacities (operator 12).

Each document is tokenised; one longer than a sequence is cut into pieces.  Pieces go, longest first, to the open sequence
with the least room that still takes them; a segment tree over the rooms 0 to 2048 finds it in logarithmic time, and a new
sequence is opened if there is none.  Which sequence that is depends on lengths alone, so the tree runs over the histogram
of lengths, and sequences with the same room are a run of numbers: where the tightest room takes q pieces of a length, so
does each sequence of the run, and one step of the tree deals a whole run.  The result is that of placing one piece after
another.  Rows meet the plan by their rank among the pieces of their length; the plan's size depends on the capacity, not
on the number of pieces.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, table, text_slices

END = 0
#: bytes of text looked at together, and words that a worker remembers before it forgets all
_SLICE, _REMEMBERED = 1 << 23, 1 << 19


#: words that the tokenizer splits in letters and what follows them
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?&*$%-]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*prints}))}


class _Encoder:
    """Texts -> ids.  White space of ASCII always ends a token and is no part of one, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def part(self, text: str) -> bytes:
        """Ids of letters of Latin-1, or of marks: no rule but that of case stands between them and the model."""
        found = self.parts.get(text)
        if found is None:
            spelt = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            found = self.parts[text] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return found

    def words(self, new: list[str]) -> list[bytes]:
        """Ids of words, four bytes each."""
        out: list = []
        rest = []
        for w in new:
            if m := _PLAIN.fullmatch(w):
                out.append(self.part(m[1].lower()) + self.part(m[2]))
            else:
                rest.append(len(out))
                out.append(w)
        if rest:
            for k, x in zip(rest, self.tokenizer.encode_batch_fast([out[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = array("I", x.ids).tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; number of ids by text).  There are no nulls."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.known) > _REMEMBERED:
            self.forget()
        place = list(map(self.known.get, unique))
        new = [w for w, k in zip(unique, place, strict=True) if k is None]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        fresh = iter(range(len(self.known) - len(new), len(self.known)))
        place = np.fromiter((next(fresh) if k is None else k for k in place), np.int32, len(place))
        found = self.words(new)
        self.lengths = np.append(self.lengths, np.fromiter(map(len, found), np.int64, len(found)) // 4)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(found), "<u4"))
        # the end is one more word
        first = np.append(np.cumsum(self.lengths) - self.lengths, len(self.ids))
        lengths, ids = np.append(self.lengths, 1), np.append(self.ids, np.uint32(END))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        place = np.insert(place[coded.indices.to_numpy()], offsets[1:], len(lengths) - 1)
        size = lengths[place]
        ends = np.cumsum(size)
        at = np.repeat((first[place] - (ends - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return ids[at], np.diff(ends[offsets[1:] + np.arange(len(texts))], prepend=0)


@functools.lru_cache(maxsize=1)
def _encoder(folder: str | None) -> _Encoder:
    """One for each worker and folder, which the worker's tasks share."""
    import public_tokenizers

    name = "word_bpe_49k.json"
    return _Encoder(f"{folder}/{name}" if folder else str(public_tokenizers.path(name)))


def pieces(docs: DataFrame, window: int = 2048, tokenizers: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for.

    ``tokenizers``: folder of the tokenizer files, at the same path on all executors.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        encode = _encoder(tokenizers).encode
        for batch in batches:
            texts = batch.column("text").fill_null("")
            for lo, hi, *_ in text_slices(texts, _SLICE):
                ids, counts = encode(texts.slice(lo, hi - lo))
                parts = -(-counts // window)
                doc = np.repeat(np.arange(hi - lo), parts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(window, counts[doc] - number * window)
                begin = (np.cumsum(counts) - counts)[doc] + number * window
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(doc))
                out = [batch.column("doc_id").take(pa.array(lo + doc)), pa.array(number.astype(np.int32)), pa.array(number * window), pa.array(length), pa.array(crc)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


# ---------------------------------------------------------------- the plan


class RoomTree:
    """Segment tree over rooms 0 to ``most``: how many open sequences have each, and the least room of at least ``need``."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, times: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += times
            i >>= 1

    def tightest(self, need: int) -> int | None:
        i = need + self.size
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:  # up to where the right neighbour has one
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(hist: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), in order.

    Pieces of a length from that rank on, up to the next row's, go to that sequence and those after it, so many to each.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    tree = RoomTree(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    opened = 0

    def give(room: int, first: int, times: int) -> None:
        if room and times:
            runs.setdefault(room, []).append((first, times))
            tree.add(room, times)

    for length in map(int, np.flatnonzero(hist)[::-1]):
        done, n = 0, int(hist[length])
        while done < n:
            room = tree.tightest(length)
            if room is None:
                room, first, times = window, opened, -(-(n - done) // (window // length))
                opened += times
            else:
                first, times = runs[room].pop()
                tree.add(room, -times)
            each = room // length
            full = min(times, (n - done) // each)
            if full:
                rows.append((length, done, each, first, window - room))
                done += full * each
                give(room - each * length, first, full)
            if full < times and done < n:
                rows.append((length, done, n - done, first + full, window - room))
                give(room - (n - done) * length, first + full, 1)
                full, done = full + 1, n
            give(room, first + full, times - full)
    return rows


def pack(cuts: DataFrame, window: int = 2048, slice_rows: int = 1 << 10, most: int = 1 << 20) -> DataFrame:
    """Deal ``cuts`` (doc_id, piece, ids_crc32, length and others, lengths from 1 to ``window``) into sequences: adds sequence_id and offset.

    Pieces of a length are ranked in slices of about ``slice_rows`` that a hash deals, or larger ones so that there are no
    more than ``most`` and one for each length: a length that most pieces share is not in one task.
    """
    spark = cuts.sparkSession
    hist = np.zeros(window + 1, np.int64)
    for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most window rows
        hist[r.length] = r.n
    slice_rows = max(slice_rows, -(-int(hist.sum()) // most))
    slices = spark.createDataFrame([(n, int(-(-hist[n] // slice_rows))) for n in map(int, np.flatnonzero(hist))], "length long, _slices long")
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_slices")).cast("int")
    cuts = cuts.join(F.broadcast(slices), "length").select(*cuts.columns, dealt.alias("_slice"))
    counts = cut(cuts.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cuts.withColumn("_place", place).join(F.broadcast(counts.select("length", "_slice", before.alias("_before"))), ["length", "_slice"])
    ranked = ranked.withColumn("_rank", (F.col("_before") + F.col("_place")).cast("long")).drop("_slice", "_place", "_before")
    plan = np.array(sorted(best_fit_decreasing(hist, window)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, lowest, each, first, offset = shared.value.T
        keys = size << 48 | lowest
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            i = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            along, within = np.divmod(rank - lowest[i], each[i])
            kept = batch.select([n for n in batch.schema.names if n != "_rank"])
            yield kept.append_column("sequence_id", pa.array(first[i] + along)).append_column("offset", pa.array(offset[i] + within * length))

    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    return ranked.mapInArrow(assign, T.StructType(fields).add("sequence_id", "long").add("offset", "long"))


def pack_best_fit(docs: DataFrame, window: int = 2048, tokenizers: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``window`` ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are numbered gapless from 0.  Null and empty texts are the end id alone.  Null and repeated ids and repeated
    rows are documents like others.  Other columns are ignored; an empty table gives an empty result.
    """
    out = pack(cut(pieces(docs, window, tokenizers)), window)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"))
