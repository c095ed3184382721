"""Incremental ingestion: events, dedupe, version fencing, status, outcomes, and chunks kept current by micro-batches.

What can be said of a batch is a DataFrame function that serves both a stream's micro-batches and tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ragspark.functions.text import backoff
from ragspark.operators.stats import register_documents
from ragspark.sources.index import Index
from ragspark.sources.snapshots import Snapshots

EVENT = "eventId long, documentId long, parseVersion long, attempt int"
MOST_ATTEMPTS = 5


def parse_events(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) of JSON texts.  All four numbers must be there and positive.  Works on streams and tables."""
    e = raw.withColumn("_e", F.from_json(value, EVENT))
    good = F.lit(True)
    for f in ("eventId", "documentId", "parseVersion", "attempt"):
        good = good & (F.coalesce(F.col(f"_e.{f}"), F.lit(0)) > 0)
    e = e.withColumn("_good", good)
    events = e.where("_good").select(*[c for c in raw.columns if c != value], F.col("_e.eventId").alias("event_id"), F.col("_e.documentId").alias("document_id"), F.col("_e.parseVersion").alias("parse_version"), F.col("_e.attempt").alias("attempt"))
    return events, e.where("NOT _good").drop("_e", "_good")


def dedupe_stream(uploads: DataFrame, ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Uploads of a stream without repeats of (dataset_id, file_hash) within the watermark.  An empty hash never repeats.

    State ends with the watermark; what must hold for ever is :func:`register_stream`.
    """
    key = F.when(F.coalesce("file_hash", F.lit("")) == "", F.concat(F.lit("#"), F.coalesce(F.col("document_id").cast("string"), F.uuid()))).otherwise(F.col("file_hash"))
    return uploads.withColumn("_key", key).withWatermark(ts, within).dropDuplicatesWithinWatermark(["dataset_id", "_key"]).drop("_key")


#: status -> percent; fixed values
STAGES = {"pending": 0, "parsing": 10, "chunking": 40, "embedding": 60, "done": 100}
_FENCED = "document_id long, event_id long, parse_version long, acted boolean, status string, progress int"
_STATE = "version long, status string, attempt int"


def _advance(state: tuple | None, event: Any) -> tuple[tuple, bool]:
    """State (version, status, attempt) after an event, and whether it acted.

    A higher version starts anew, a lower one is ignored, as is all that comes after done.  A stop wins over progress.
    """
    version, status, attempt = state or (0, "pending", 0)
    v, s = int(event.parse_version), event.status
    if v < version:
        return (version, status, attempt), False
    if v > version:
        version, status, attempt = v, "pending", 0
    elif status in ("done", "cancelled"):
        return (version, status, attempt), False
    if status == "cancelling" and s != "cancelled":
        return (version, status, attempt), False
    return (version, s, max(attempt, int(event.attempt))), True


class Fence(StatefulProcessor):
    """Keyed state of each document: which events act, and the status after each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values("event_id").itertuples():  # a document's events may come in several parts
            state, acted = _advance(state, e)
            out.append((key[0], e.event_id, e.parse_version, acted, state[1], STAGES.get(state[1], 0)))
        if state:
            self.state.update(state)
        yield pd.DataFrame(out, columns=["document_id", "event_id", "parse_version", "acted", "status", "progress"])

    def close(self) -> None:
        pass


def fence_versions(events: DataFrame) -> DataFrame:
    """A stream of events (document_id, event_id, parse_version, attempt, status) with ``acted`` and the status after each."""
    return events.groupBy("document_id").transformWithStateInPandas(statefulProcessor=Fence(), outputStructType=_FENCED, outputMode="append", timeMode="None")


def status_timeline(events: DataFrame) -> DataFrame:
    """document_id, event_id, status, progress: what each event that acted made of its document."""
    return fence_versions(events).where("acted").select("document_id", "event_id", "status", "progress")


def fenced_batch(events: DataFrame) -> DataFrame:
    """The batch's end state: document_id, parse_version, status and attempt of the highest version after its last event that acts.

    Nothing acts after done or cancelled, and after a stop (cancelling) only cancelled does.
    """
    before = Window.partitionBy("document_id", "parse_version").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    status = F.col("status")
    held = F.first(F.when(status.isin("done", "cancelling", "cancelled"), status), ignorenulls=True).over(before)
    over = F.coalesce(F.max(status == "cancelled").over(before), F.lit(False))
    acting = events.withColumn("_held", held).withColumn("_over", over).where((F.col("_held").isNull()) | ((F.col("_held") == "cancelling") & (status == "cancelled") & ~F.col("_over")))
    each = acting.groupBy("document_id", "parse_version").agg(F.max_by("status", "event_id").alias("status"), F.max("attempt").alias("attempt"))
    out = each.groupBy("document_id").agg(F.max_by(F.struct("parse_version", "status", "attempt"), "parse_version").alias("x"))
    return out.select("document_id", "x.*")


def route_outcomes(outcomes: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """What becomes of each handled event: action (success, retry, dead), next_attempt, wait_s.

    outcomes: event_id, attempt, outcome (ok, retryable, permanent, no_penalty, malformed).  A retry without penalty keeps
    its attempt; one that has used up its attempts is dead.
    """
    kind, attempt = F.col("outcome"), F.col("attempt")
    action = F.when(kind == "ok", "success").when(kind.isin("permanent", "malformed"), "dead").when(kind == "no_penalty", "retry").when(attempt >= most, "dead").otherwise("retry")
    rows = outcomes.withColumn("action", action)
    again = F.when(F.col("action") == "retry", F.when(kind == "no_penalty", attempt).otherwise(attempt + 1))
    return rows.withColumn("next_attempt", again.cast("int")).withColumn("wait_s", F.when(F.col("action") == "retry", backoff(attempt)))


_RETRIED = "event_id long, action string, attempt int, at_ms long"
_WAITS = "phase string, attempt int, due_ms long"


def next_step(outcome: str, attempt: int, most: int = MOST_ATTEMPTS) -> tuple[str, int, int]:
    """(action, next attempt, seconds to wait) of one outcome, by the rule of :func:`route_outcomes`."""
    if outcome == "ok":
        return "success", attempt, 0
    if outcome in ("permanent", "malformed") or (outcome != "no_penalty" and attempt >= most):
        return "dead", attempt, 0
    return "retry", attempt if outcome == "no_penalty" else attempt + 1, min(60, 2 ** (max(1, attempt) - 1))


class Retries(StatefulProcessor):
    """Keyed state of each event: it waits for its time, or is being worked on under a lease.

    An outcome ends the work, or puts the event off by its backoff; a timer publishes it again when that has passed, or
    when the lease ends without an outcome, then at the same attempt.
    """

    def __init__(self, lease_s: int, most: int, by_events: bool = False):
        self.lease, self.most, self.by_events = 1000 * lease_s, most, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _WAITS)

    def _set(self, phase: str, attempt: int, due: int) -> None:
        if self.state.exists():
            self.handle.deleteTimer(int(self.state.get()[2]))
        self.state.update((phase, attempt, due))
        self.handle.registerTimer(due)

    def _now(self, timers: Any) -> int:
        return max(0, timers.getCurrentWatermarkInMs()) if self.by_events else timers.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, now = [], self._now(timerValues)
        for e in pd.concat(list(rows)).sort_values(["attempt", "outcome"]).itertuples():
            held = self.state.get() if self.state.exists() else None
            if held is not None and held[0] == "over":
                continue
            attempt = int(e.attempt)
            if held is not None and attempt < int(held[1]):
                continue  # of an attempt that was given up
            if e.outcome == "started":
                self._set("working", attempt, now + self.lease)
                continue
            action, after, wait = next_step(e.outcome, attempt, self.most)
            if action == "retry":
                self._set("waiting", after, now + 1000 * wait)
                continue
            if held is not None:
                self.handle.deleteTimer(int(held[2]))
            self.state.update(("over", attempt, 0))
            out.append((key[0], action, attempt, now))
        yield pd.DataFrame(out, columns=["event_id", "action", "attempt", "at_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, now = expiredTimerInfo.getExpiryTimeInMs(), self._now(timerValues)
        phase, attempt, due = self.state.get() if self.state.exists() else ("over", 0, 0)
        out = []
        if phase != "over" and int(due) == at:
            # published: it is being worked on from now
            self.state.update(("working", int(attempt), now + self.lease))
            self.handle.registerTimer(now + self.lease)
            out.append((key[0], "publish", int(attempt), at))
        yield pd.DataFrame(out, columns=["event_id", "action", "attempt", "at_ms"])

    def close(self) -> None:
        pass


def delayed_retries(outcomes: DataFrame, lease_s: int = 300, most: int = MOST_ATTEMPTS, time_mode: str = "ProcessingTime") -> DataFrame:
    """A stream of outcomes (event_id, attempt, outcome: started or one of :func:`route_outcomes`) with what follows: event_id, action, attempt, at_ms.

    ``publish``: the event is due again, after its backoff or as its lease has ended; ``success``, ``dead``: it is over.
    With the time mode ``EventTime`` the stream's watermark is the clock.
    """
    return outcomes.groupBy("event_id").transformWithStateInPandas(statefulProcessor=Retries(lease_s, most, time_mode == "EventTime"), outputStructType=_RETRIED, outputMode="append", timeMode=time_mode)


def ingest_stream(documents: DataFrame, build: Callable[[DataFrame], DataFrame], index: Index, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None):  # noqa: ANN201
    """Keep an index current: each micro-batch of ``documents`` (document_id, parse_version and others) is one commit.

    Chunks, vectors and postings of a batch appear together.  A version below the stored one changes nothing, whenever it
    comes.  The commit notes the batch, so one that is replayed after it was stored is passed over; under another
    checkpoint it leaves the same state.
    """
    name = f"batch of {checkpoint}"

    def one(batch: DataFrame, batch_id: int) -> None:
        if index.manifest()["notes"].get(name, -1) < batch_id:
            index.put(batch, build, embed, {name: batch_id})

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def register_stream(uploads: DataFrame, store: Snapshots, checkpoint: str):  # noqa: ANN201
    """Register uploads (document_id, dataset_id, file_hash) for ever: of equal files of a data set the first stays.

    Each micro-batch is held against the table ``uploads`` of all that came before (no state grows in the stream), and
    those with a file that is there point to its document.  An empty hash never repeats.  Rows stored: document_id,
    dataset_id, file_hash, registered_id, is_new.
    """
    name = f"batch of {checkpoint}"

    def one(batch: DataFrame, batch_id: int) -> None:
        m = store.manifest()
        if m["notes"].get(name, -1) >= batch_id:
            return
        rows = register_documents(batch.dropDuplicates(["document_id"]).withColumn("file_hash", F.coalesce("file_hash", F.lit("")))).select("document_id", "dataset_id", "file_hash", "registered_id")
        if "uploads" in m["tables"]:
            before = store.read("uploads")
            rows = rows.join(before.select("document_id"), "document_id", "left_anti")  # the same upload again
            known = before.where("is_new AND file_hash <> ''").select("dataset_id", "file_hash", F.col("document_id").alias("_known"))
            rows = rows.join(known, ["dataset_id", "file_hash"], "left").withColumn("registered_id", F.coalesce("_known", "registered_id"))
        rows = rows.withColumn("is_new", F.col("registered_id") == F.col("document_id"))
        store.replace({"uploads": rows.select("document_id", "dataset_id", "file_hash", "registered_id", "is_new")}, None, None, {name: batch_id})

    return uploads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
