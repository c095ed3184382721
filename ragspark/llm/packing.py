"""Packing by non-negative least squares over a histogram of lengths (operator 4).

Each document is tokenised and cut into windows of 1024 ids and one rest.  The rests' lengths form a histogram.  All
combinations of at most three lengths that fill a window exactly (and the lengths that are a power of two, which need no
padding by themselves) are enumerated; non-negative repeat counts that explain the histogram best are found by projected
gradient descent, rounded down, and what is left is packed greedily, best fit first.  All that depends on the histogram
of 1024 numbers alone; rows meet the resulting plan by a broadcast of at most one row for each combination and length, and one for each slice
of a length (a million at most).
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, table, text_slices

END = 0


#: white space with the word after it
_WORD = re.compile(r"\s*\S+|\s+")
_WORD_END = re.compile(r"\S(?=\s)")
#: words that the tokenizer splits in letters or digits, with the space before them, and the marks at their end
_PLAIN = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+)([.,;:!?&*$%-]*)")
#: white space at an end, or two beside each other
_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = rf"\A{_SPACE}|{_SPACE}\z|{_SPACE}{_SPACE}|\A\z"
#: characters of a text that are split into words at once, and of words that a worker remembers if not told otherwise
_RUN, _REMEMBERED = 1 << 18, 1 << 23


def _runs(text: str) -> Iterator[list[str]]:
    """The words of runs of a text; a run ends with a word."""
    at = 0
    while at < len(text):
        end = _WORD_END.search(text, at + _RUN)
        to = end.end() if end else len(text)
        yield _WORD.findall(text, at, to)
        at = to


class _Encoder:
    """Text -> array of ids.

    The tokenizer never joins a word with the white space after it, so that a text's ids are those of its words in a row.
    A worker tokenises a word once and remembers it, up to a number of characters at which it forgets all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the letter that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*prints}))}
        self.most = _REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.held = 0

    def part(self, text: str) -> bytes:
        """Ids of letters of Latin-1, digits or marks, with a space before them or none: no rule stands between them and the model."""
        found = self.parts.get(text)
        if found is None:
            spelt = text.encode().decode("latin-1").translate(self.letters)
            found = self.parts[text] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            self.held += len(text)
        return found

    def _learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words, four bytes each, by word; those not seen before are tokenised."""
        if self.held > self.most:
            self.forget()
        known = self.known
        if new := {w for w in words if w not in known}:
            self.held += sum(map(len, new))
            other, part = [], self.part
            for w in new:
                if m := _PLAIN.fullmatch(w):
                    start = part("\n") + part(m[2]) if m[1] == "\n" else part(m[1] + m[2])
                    known[w] = start + part(m[3])
                else:
                    other.append(w)
            known.update(zip(other, (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))
        return known

    def encode(self, text: str) -> np.ndarray:
        out = []
        for words in _runs(text):
            out.append(b"".join(map(self._learn(words).__getitem__, words)))
        return np.frombuffer(b"".join(out), "<u4")

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text.  Texts in which no white space stands beside another, or at an end, are split together."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.encode(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        # a line end begins a word as a space does
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
        words = split.flatten()
        coded = words.dictionary_encode()
        spaced = [w if w[:1] == "\n" else f" {w}" for w in coded.dictionary.to_pylist()]
        offsets = split.offsets.to_numpy()
        first = words.take(pa.array(offsets[:-1])).to_pylist()
        known = self._learn(chain(spaced, first))
        parts = list(map(known.__getitem__, spaced)) + list(map(known.__getitem__, first))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        place = coded.indices.to_numpy().copy()
        place[offsets[:-1]] = len(spaced) + np.arange(len(first))  # no space before the first word
        size = lengths[place]
        ends = np.cumsum(size)
        at = np.repeat(((np.cumsum(lengths) - lengths)[place] - (ends - size)).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        for i, x in zip(plain.tolist(), np.split(ids[at], ends[offsets[1:-1] - 1]) if len(plain) else [], strict=True):
            out[i] = x
        return out


@functools.lru_cache(maxsize=1)
def _encoder(folder: str | None) -> _Encoder:
    """One for each worker and folder, which the worker's tasks share."""
    import public_tokenizers

    name = "byte_bpe_50k.json"
    return _Encoder(f"{folder}/{name}" if folder else str(public_tokenizers.path(name)))


def pieces(docs: DataFrame, window: int = 1024, tokenizers: str | None = None, with_ids: bool = False, remember: int = _REMEMBERED) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for.

    ``tokenizers``: folder of the tokenizer files, at the same path on all executors.  ``remember``: characters of words
    whose ids a worker keeps; about twenty bytes of memory each, which stay with the worker, against tokenising them again.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        encoder = _encoder(tokenizers)
        encoder.most, encode = remember, encoder.encode_all
        for batch in batches:
            docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
            for lo, hi, *_ in text_slices(texts, min(1 << 22, max(1 << 20, remember))):
                out: list[tuple] = []
                for doc_id, found in zip(docs_[lo:hi], encode(texts[lo:hi]), strict=True):
                    ids = np.append(found, np.array([END], "<u4"))
                    for s in range(0, len(ids), window):
                        part = ids[s : s + window]
                        out.append((doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype(np.int32)] * with_ids)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


# ---------------------------------------------------------------- the plan


def combinations(window: int) -> np.ndarray:
    """Rows of up to three lengths, 0 for none, that fill the window; and single powers of two."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a <= b) & (b <= c)
    three = np.stack([a[ok], b[ok], c[ok]], 1)
    p = np.arange(1, window // 2 + 1)
    two = np.stack([p, window - p, np.zeros_like(p)], 1)
    ones = 1 << np.arange(window.bit_length())
    one = np.stack([ones[ones <= window], np.zeros_like(ones[ones <= window]), np.zeros_like(ones[ones <= window])], 1)
    return np.concatenate([one, two, three])


def solve(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x for which the lengths used by ``combos`` come closest to ``hist`` in squares (accelerated projected gradient)."""
    n = len(hist)
    present = hist > 0
    present[0] = True  # length 0: no piece
    use = present[combos].all(axis=1)
    c = combos[use]
    out = np.zeros(len(combos))
    if not len(c):
        return out
    cols = [(c[:, j], (c[:, j] > 0).astype(float)) for j in range(3)]

    def made(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(k, x * m, n) for k, m in cols)

    # the largest eigenvalue of A'A, by power iteration
    v = np.ones(len(c))
    for _ in range(20):
        r = made(v)
        v = sum(r[k] * m for k, m in cols)
        norm = np.linalg.norm(v)
        v /= norm
    rate = 1 / (norm * 1.05)
    x = y = np.zeros(len(c))
    t = 1.0
    for _ in range(steps):
        r = made(y) - hist
        new = np.maximum(0, y - rate * sum(r[k] * m for k, m in cols))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    out[use] = x
    return out


def make_plan(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often): together they hold exactly ``hist[n]`` pieces of each length n."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(window)
    x = np.floor(solve(combos, left.astype(float)) + 1e-6).astype(np.int64)
    for i in sorted(np.flatnonzero(x), key=lambda i: -x[i]):
        parts = [int(n) for n in combos[i] if n]
        need = {n: parts.count(n) for n in parts}
        times = min(int(x[i]), *(int(left[n]) // k for n, k in need.items()))
        if times:
            plan.append((tuple(parts), times))
            for n, k in need.items():
                left[n] -= times * k
    # the rest, greedily: the longest piece, then again and again the longest that still fits
    while (live := np.flatnonzero(left)).size:
        room, parts = window, []
        taken: dict[int, int] = {}
        while room and (live := live[live <= room]).size:
            n = int(live[-1])
            if left[n] <= taken.get(n, 0):
                live = live[:-1]
                continue
            parts.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        times = min(int(left[n]) // k for n, k in taken.items())
        plan.append((tuple(parts), times))
        for n, k in taken.items():
            left[n] -= times * k
    return plan


def pack(cuts: DataFrame, window: int = 1024, slice_rows: int = 1 << 10, most: int = 1 << 20) -> DataFrame:
    """Deal ``cuts`` (doc_id, start, length and others, lengths from 1 to ``window``) into sequences: adds sequence_id and offset.

    Sequences are numbered gapless from 0.  The pieces of a length are counted in slices of about ``slice_rows``, or larger
    ones so that there are no more than ``most`` and one for each length: a length that most pieces share is not in one task.
    Repeated rows are pieces of their own.
    """
    spark = cuts.sparkSession
    hist = np.zeros(window + 1, np.int64)
    for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most window rows
        hist[r.length] = r.n
    slice_rows = max(slice_rows, -(-int(hist.sum()) // most))
    slices = spark.createDataFrame([(n, int(-(-hist[n] // slice_rows))) for n in map(int, np.flatnonzero(hist))], "length long, _slices long")
    dealt = F.pmod(F.xxhash64("doc_id", "start"), F.col("_slices")).cast("int")
    cuts = cuts.join(F.broadcast(slices), "length").select(*cuts.columns, dealt.alias("_slice"))
    counts = cut(cuts.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    rows, seq, used = [], 0, np.zeros(window + 1, np.int64)
    for parts, times in make_plan(hist, window):
        at = 0
        for n in parts:
            # pieces used[n], used[n] + 1, ... of this length go, one each, to sequences seq, seq + 1, ...
            rows.append((n, int(used[n]), int(used[n]) + times, seq - int(used[n]), at))
            used[n] += times
            at += n
        seq += times
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "start"))
    ranked = cuts.withColumn("_place", place).join(F.broadcast(offsets), ["length", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table_[:, 0] << 48 | table_[:, 1], table_[:, 3], table_[:, 4]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shift, offset = shared.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            i = np.searchsorted(first, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            kept = batch.select([n for n in batch.schema.names if n != "_rank"])
            yield kept.append_column("sequence_id", pa.array(rank + shift[i])).append_column("offset", pa.array(offset[i]))

    ranked = ranked.drop("_slice", "_place", "_before").withColumn("_rank", F.col("_rank").cast("long"))
    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    return ranked.mapInArrow(assign, T.StructType(fields).add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, window: int = 1024, remember: int = _REMEMBERED) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  Null and empty texts are the end id
    alone.  Null and repeated ids and repeated rows are documents like others.  Other columns are ignored; an empty table
    gives an empty result.  ``remember``: see :func:`pieces`.
    """
    out = pack(cut(pieces(docs, window, remember=remember)), window)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
