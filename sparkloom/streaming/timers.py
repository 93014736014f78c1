"""The change feed with timers: state that acts by itself when nothing comes, and goes when it is no longer needed.

Each operator keeps a few values for a key in Spark's RocksDB state store and sets a timer in event time (all, `ttl` aside):
a path or repository that has been quiet is flushed, a claim that nobody finished is released, and a finished job is
forgotten. What comes behind the watermark is dropped. `use_rocksdb` must be called before a stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(ts: pd.Series) -> list[int]:
    return [int(x.timestamp() * 1000) for x in pd.to_datetime(ts, utc=True)]


def _in_order(rows: Iterator[pd.DataFrame]) -> list[tuple[int, dict]]:
    """A batch's events of one key by time, those of one time as they came."""
    found = [(ms, r) for df in rows for ms, r in zip(_ms(df["ts"]), df.to_dict("records"), strict=True)]
    return sorted(found, key=lambda x: x[0])


class _Timed(StatefulProcessor):
    """One timer a key: a new one takes the place of the old."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def alarm(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class QuietPath(_Timed):
    """The last event of a path and how many there were, once it has been quiet for `quiet` ms."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "op string, start long, at long, n long")

    def _flushed(self, key: tuple) -> pd.DataFrame:
        op, start, at, n = self.last.get()
        return pd.DataFrame({"path": [key[0]], "op": [op], "start": [start], "at": [at], "n": [n]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for at, r in _in_order(rows):
            start, n = at, 0
            if self.last.exists():
                _, start, before, n = self.last.get()
                if at - before >= self.quiet:
                    yield self._flushed(key)
                    start, n = at, 0
            self.last.update((r["op"], start, at, n + 1))
        self.alarm(self.last.get()[2] + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._flushed(key)
            self.last.clear()


def quiet_paths(events: DataFrame, quiet_ms: int = 500, late: str = "10 seconds") -> DataFrame:
    """path, op, ts -> path, op (the last), start, at (ms of the first and last event), n."""
    return events.withWatermark("ts", late).groupBy("path").transformWithStateInPandas(QuietPath(quiet_ms), "path string, op string, start long, at long, n long", "Append", "EventTime")


class QuietRepository(_Timed):
    """Jobs for what changed in a repository, once the whole of it has been quiet for `quiet` ms."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.paths = handle.getMapState("paths", "path string", "kind string")
        self.last = handle.getValueState("last", "at long")

    def _jobs(self, key: tuple) -> Iterator[pd.DataFrame]:
        kinds: dict[str, list[str]] = {}
        for (path,), (kind,) in self.paths.iterator():
            kinds.setdefault(kind, []).append(path)
        for kind, found in sorted(kinds.items()):
            job = "DOCS_SCAN" if kind == "doc" else "REINDEX_FILE" if len(found) == 1 else "REINDEX_MANY"
            yield pd.DataFrame({"repo": [key[0]], "job": [job], "paths": [sorted(found)]})
        self.paths.clear()
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = None
        for at, r in _in_order(rows):
            if self.last.exists() and at - self.last.get()[0] >= self.quiet:
                yield from self._jobs(key)
            self.paths.updateValue((r["path"],), (r["kind"],))
            self.last.update((at,))
        self.alarm(self.last.get()[0] + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield from self._jobs(key)


def quiet_repositories(events: DataFrame, quiet_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """repo, path, kind (code or doc), ts -> repo, job, paths: one job for the code and one for the documents that changed."""
    return events.withWatermark("ts", late).groupBy("repo").transformWithStateInPandas(QuietRepository(quiet_ms), "repo string, job string, paths array<string>", "Append", "EventTime")


class ClaimedJob(_Timed):
    """A job's state machine that releases claims by itself: a claim that isn't completed or failed within `hold` ms makes the
    job pending again, or failed after `most` attempts. Finished jobs are forgotten after `keep` ms."""

    def __init__(self, hold: int, most: int, keep: int) -> None:
        self.hold, self.most, self.keep = hold, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, attempts int, at long")

    def _now(self, key: tuple, status: str, attempts: int, at: int, why: str) -> pd.DataFrame:
        self.job.update((status, attempts, at))
        self.alarm(at + self.hold if status == "CLAIMED" else at + self.keep if status in ("DONE", "FAILED") else None)
        return pd.DataFrame({"id": [key[0]], "status": [status], "attempts": [attempts], "at": [at], "why": [why]})

    def _released(self, key: tuple, attempts: int, at: int) -> pd.DataFrame:
        return self._now(key, "PENDING" if attempts < self.most else "FAILED", attempts, at, "released")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for at, r in _in_order(rows):
            status, attempts, before = self.job.get() if self.job.exists() else ("PENDING", 0, at)
            if status == "CLAIMED" and at - before >= self.hold:
                #: the claim ran out before this event; rows of a batch come before its timers
                yield self._released(key, attempts, before + self.hold)
                status, attempts, before = self.job.get()
            elif status in ("DONE", "FAILED") and at - before >= self.keep:
                status, attempts = "PENDING", 0
            if r["op"] == "claim" and status == "PENDING":
                yield self._now(key, "CLAIMED", attempts + 1, at, "claim")
            elif r["op"] == "complete" and status == "CLAIMED":
                yield self._now(key, "DONE", attempts, at, "complete")
            elif r["op"] == "fail" and status == "CLAIMED":
                yield self._now(key, "PENDING" if attempts < self.most else "FAILED", attempts, at, "fail")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        status, attempts, at = self.job.get()
        if status == "CLAIMED":
            yield self._released(key, attempts, at + self.hold)
        elif status in ("DONE", "FAILED"):
            self.job.clear()


def claimed_jobs(transitions: DataFrame, hold_ms: int = 30 * 60 * 1000, most: int = 3, keep_ms: int = 24 * 3600 * 1000, late: str = "10 seconds") -> DataFrame:
    """id, op (claim, complete, fail), ts -> a row for each change: id, status, attempts, at (ms), why (the op, or released)."""
    return transitions.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(ClaimedJob(hold_ms, most, keep_ms), "id long, status string, attempts int, at long, why string", "Append", "EventTime")


class FirstSeen(StatefulProcessor):
    """The first row of each key; the key is forgotten when it hasn't come for the time to live, by the machine's clock."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        self.seen.update((True,))
        if new:
            yield pd.DataFrame({"dedup_key": [key[0]]})

    def close(self) -> None:
        pass


def first_jobs(jobs: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """dedup_key -> dedup_key, once while it keeps coming; state lives for `ttl_ms` after the last row of a key."""
    return jobs.groupBy("dedup_key").transformWithStateInPandas(FirstSeen(ttl_ms), "dedup_key string", "Append", "ProcessingTime")
