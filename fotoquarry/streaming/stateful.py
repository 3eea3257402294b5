"""Streams with state of their own: debouncing by timer, pending requests, answers that hold.

State lies in the stream's state store (RocksDB, which these operators need) and has an end: a timer
that fires removes what it waited for, and what nothing removes runs out after its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _store(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Quiet(StatefulProcessor):
    """One row a key once no event has come for so long, by the clock and without another event."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = [r["ts"] for r in rows]
        known = [t for t in times if t is not None]
        first, last, n = self.seen.get() if self.seen.exists() else (None, None, 0)
        known += [t for t in (first, last) if t is not None]
        self.seen.update((min(known, default=None), max(known, default=None), n + len(times)))
        # Every change starts the wait anew.
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            first, last, n = self.seen.get()
            self.seen.clear()
            yield Row(root=key[0], first=first, last=last, n=n)


def debounced_by_timer(events: DataFrame, quiet_seconds: float = 30.0) -> DataFrame:
    """(root, first, last, n): one row once a root has had no event for so long, with its events' first and last time and number.

    ``events``: root, ts. The wait is by the clock, so a root fires though no other event comes;
    the state of a root is one row and two numbers, gone when it has fired. A null root is a root
    like others, null times are counted only.
    """
    _store(events.sparkSession)
    own = events.select(F.col("root").cast("string").alias("root"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    fired = own.groupBy("root").transformWithState(_Quiet(int(quiet_seconds * 1000)), "root string, first long, last long, n long", "Append", "ProcessingTime")
    return fired.select("root", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n")


class _Pending(StatefulProcessor):
    """The requests of a folder that no pending one covers."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "force boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        parts = [(p["seq"].to_numpy(), p["force"].to_numpy(bool), p["done"].to_numpy(bool)) for p in rows]
        seq, force, done = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(seq, kind="stable")
        seq, force, done = seq[order], force[order], done[order]
        # The requests of a wait: the first and, if that is not forced, the first forced one; what waited before counts as one.
        was, run = (bool(self.pending.get()[0]) if self.pending.exists() else None), np.cumsum(done)
        asked = np.flatnonzero(~done)
        first = asked[np.unique(run[asked], return_index=True)[1]]
        forced = asked[force[asked]]
        forced = forced[np.unique(run[forced], return_index=True)[1]]
        if was is not None:
            first = first[run[first] > 0]
            forced = forced[run[forced] > 0] if was else forced
        kept = np.union1d(first, forced)
        last = kept[run[kept] == run[-1]] if len(run) else kept
        if len(last):
            self.pending.update((bool(force[last].any()),))
        elif done.any():
            self.pending.clear()
        if len(kept):
            yield pd.DataFrame({"folder": [key[0]] * len(kept), "force": force[kept], "seq": seq[kept]})


def pending_requests(requests: DataFrame, ttl_seconds: float = 86_400.0) -> DataFrame:
    """(folder, force, seq): the requests that are worth queueing.

    ``requests``: folder, force, done, seq, in the order of seq within a batch. A request is
    dropped while one for its folder waits or runs that is forced or as little forced; a row that
    is done ends the wait. The state is one flag a folder, gone when done or after its time to live.
    """
    _store(requests.sparkSession)
    own = requests.selectExpr("folder", "coalesce(force, false) AS force", "coalesce(done, false) AS done", "seq").where("seq IS NOT NULL")
    return own.groupBy("folder").transformWithStateInPandas(_Pending(int(ttl_seconds * 1000)), "folder string, force boolean, seq long", "Append", "ProcessingTime")


class _Answers(StatefulProcessor):
    """The latest answer of a pair and the one before the news, until it runs out."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ts long, seq long, answer string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held.get() if self.held.exists() else None
        now = max([(r["ts"], r["seq"], r["answer"]) for r in rows] + ([tuple(before)] if before else []), key=lambda a: a[:2])
        if before is None or now != tuple(before):
            self.held.update(now)
            yield Row(tag_id=key[0], photo_id=key[1], answer=now[2], before=before[2] if before else None, seq=now[1])


def answers_that_hold(answers: DataFrame, ttl_seconds: float = 30 * 86_400.0) -> DataFrame:
    """(tag_id, photo_id, answer, before, seq): the answer that holds now for each pair with a new one, and the one it replaces.

    ``answers``: tag_id, photo_id, answer, ts, seq; the latest by (ts, seq) holds, also over later
    batches. Rows without a time or number take no part. A pair is forgotten ``ttl_seconds`` after
    its last change; a late answer to it then counts as its first.
    """
    _store(answers.sparkSession)
    own = answers.where("ts IS NOT NULL AND seq IS NOT NULL").select("tag_id", "photo_id", "answer", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq")
    return own.groupBy("tag_id", "photo_id").transformWithState(_Answers(int(ttl_seconds * 1000)), "tag_id int, photo_id long, answer string, before string, seq long", "Update", "ProcessingTime")
