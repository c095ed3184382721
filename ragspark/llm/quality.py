"""Quality classifier by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of 64 words.  Every passage is described by shares of character classes and of pairs of
them, and by figures of its words; a dense layer encodes it.  Gated attention, softmax of w'(tanh(Vh) * sigmoid(Uh)),
weighs the passages, and a logistic layer scores the weighted sum of their codes.  All weights are learned together
from document labels, on the driver, over a bounded sample of labelled rows; all documents are then scored in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, fold_of, table, text_slices, words

PASSAGE = 64
#: classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 stop or comma, 7 ! or ?, 8 |, 9 other marks, 10 outside ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
_CLASS[[ord(c) for c in ".,;:"]], _CLASS[[ord(c) for c in "!?"]], _CLASS[ord("|")] = 6, 7, 8
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~\"'()-"]] = 9
_CLASS[128:] = 10
_KINDS = 11
N_FEATURES = _KINDS * _KINDS + 10


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, passages of each row).  A row without words has one passage of zeros."""
    h, starts, ends, counts = words(data, offsets, SPACED)
    per = np.maximum(1, -(-counts // PASSAGE))
    first = np.append(0, np.cumsum(per))
    rows = len(counts)
    out = np.zeros((first[-1], N_FEATURES), np.float32)
    if not len(h):
        return out, per
    row = np.repeat(np.arange(rows), counts)
    in_row = np.arange(len(h)) - np.repeat(np.append(0, np.cumsum(counts))[:-1], counts)
    mine = first[row] + in_row // PASSAGE
    # pairs of byte classes; bytes between two words belong to the word before
    at = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
    doc = np.searchsorted(offsets, np.arange(len(data)), side="right") - 1
    ok = (at >= 0) & (row[np.maximum(at, 0)] == doc)
    kinds = _CLASS[data]
    pair = kinds[:-1] * _KINDS + kinds[1:]
    good = ok[:-1] & (doc[:-1] == doc[1:])
    flat = np.bincount(mine[at[:-1][good]] * (_KINDS * _KINDS) + pair[good], minlength=len(out) * _KINDS * _KINDS)
    table_ = flat.reshape(len(out), -1).astype(np.float32)
    n = np.bincount(mine, minlength=len(out))
    out[:, : _KINDS * _KINDS] = np.sqrt(table_ / np.maximum(table_.sum(1, keepdims=True), 1))
    size = (ends - starts).astype(float)

    def share(x: np.ndarray) -> np.ndarray:
        return np.bincount(mine, x.astype(float), len(out)) / np.maximum(n, 1)

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    two = np.zeros(len(h), bool)
    two[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
    order = np.lexsort((h, mine))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (mine[order][1:] != mine[order][:-1])
    distinct = np.bincount(mine[order][new], minlength=len(out)) / np.maximum(n, 1)
    base = _KINDS * _KINDS
    mean = share(size)
    figures = [mean / 10, np.sqrt(np.maximum(0, share(size * size) - mean * mean)) / 5, share(same), share(two), distinct, share(size <= 3), share(size >= 12), np.log1p(n) / 4, np.log1p(np.repeat(counts, per)) / 8, share(size == 1)]
    for j, x in enumerate(figures):
        out[:, base + j] = x
    return out, per


class Attention:
    """The model.  ``fit`` uses Adam over batches of documents; the order of the sample is fixed by the caller."""

    def __init__(self, hidden: int = 32, gate: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        init = lambda a, b: (rng.standard_normal((a, b)) / a**0.5).astype(np.float32)
        self.p = {"W": init(N_FEATURES, hidden), "c": np.zeros(hidden, np.float32), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate, 1)[:, 0], "s": init(hidden, 1)[:, 0], "b": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, per: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        starts = np.append(0, np.cumsum(per))[:-1]
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.maximum(0, x @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = np.clip((t * g) @ p["w"], -30, 30)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), per))
        a = e / np.repeat(np.add.reduceat(e, starts), per)
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["s"] + p["b"][0], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each document."""
        return self._forward(x, per)["y"].astype(np.float64) if len(per) else np.zeros(0)

    def _gradients(self, x: np.ndarray, per: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, per)
        starts = np.append(0, np.cumsum(per))[:-1]
        d = (f["y"] - label) / len(per)
        dz = np.repeat(d, per)[:, None] * p["s"]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), per))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
        return {"W": f["x"].T @ dh, "c": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "s": f["z"].T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Attention:
        if not bags:
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-2
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(bags), batch):
                some = order[lo : lo + batch]
                step += 1
                grads = self._gradients(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), labels[some])
                now = rate * min(1, step / 50) * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, held: int = 2) -> Attention:
    """A model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text).

    Learns from at most ``sample`` labelled rows, those with the smallest hash of doc_id, none of them of fold ``held``
    of 4; a text teaches by all its passages.  Labels or ids that are null teach nothing; of several labels of an id the
    largest counts, of several texts the one with the smallest hash.  Without labels the
    model is untrained and scores are about a half.
    """
    known = labels.where("quality is not null and doc_id is not null").where(fold_of(F.col("doc_id"), 4) != held)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                x, per = passages(data, offsets)
                bags = [p.astype(np.float16).tobytes() for p in np.split(x, np.cumsum(per)[:-1])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in ("doc_id", "label", "hash")], pa.array(bags, pa.binary())], ["doc_id", "label", "hash", "bag"])

    # one row for each id, so at most ``sample``
    every = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(describe, "doc_id long, label int, hash long, bag binary")
    got = sorted(every.groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by("bag", "hash").alias("bag")).collect(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(bytes(r.bag), np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in got]
    return Attention().fit(bags, np.array([r.label for r in got], np.float32))


def score(docs: DataFrame, model: Attention, keep: list[str] | None = None, at: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Score and decision (1 if the score is at least ``at``), named ``names``, for each row of ``docs``, after the columns ``keep``.  Null text is empty."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 20):
                y = m.score(*passages(data, offsets))
                part = batch.select(keep).slice(lo, hi - lo)
                yield part.append_column(names[0], pa.array(y)).append_column(names[1], pa.array((y >= at).astype(np.int32)))

    wide = docs.select(*keep, *["text"] * ("text" not in keep))
    schema = docs.select(*keep).schema.add(names[0], "double").add(names[1], "integer")
    return wide.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality).

    Empty and null texts are scored as a passage without words.  Null ids are never learned from; their fold is that of
    the empty text.  Repeated rows get the same score.  Other columns are ignored.  Empty table: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
