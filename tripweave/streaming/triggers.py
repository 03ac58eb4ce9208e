"""Keyed state over streams: throttled triggers and a job registry with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripweave.settings import RETRIGGER_MS

JOB_TTL_MS = 600_000


def throttle_batch(log: DataFrame, key: str = "id", at: str = "at_ms", window: int = RETRIGGER_MS) -> DataFrame:
    """Accepts the first trigger of a key and each one at least ``window`` after the last accepted."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        ok, last = [], None
        for t in rows[at]:
            ok.append(last is None or t - last >= window)
            last = t if ok[-1] else last
        return rows.assign(accepted=ok)

    return log.groupBy(key).applyInPandas(run, log.withColumn("accepted", F.lit(True)).schema)


def throttle_stream(log: DataFrame, key: str = "id", at: str = "at_ms", window: int = RETRIGGER_MS) -> DataFrame:
    """The same over a stream: the state of a key is the time of its last accepted trigger."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in frames:
            rows = rows.sort_values(at)
            ok = []
            for t in rows[at]:
                ok.append(last is None or t - last >= window)
                last = int(t) if ok[-1] else last
            yield pd.DataFrame({"id": rows[key], "at_ms": rows[at], "accepted": ok})
        if last is not None:
            state.update((last,))

    return log.groupBy(key).applyInPandasWithState(run, "id long, at_ms long, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def job_status(events: DataFrame, now_ms: int, ttl: int = JOB_TTL_MS) -> DataFrame:
    """(job, status): the last of queued, failed or succeeded; ended jobs are not_found after ``ttl``."""
    last = events.groupBy("job").agg(F.max_by(F.struct("status", "at_ms"), F.struct("at_ms", "status")).alias("l"))
    old = F.col("l.status").isin("succeeded", "failed") & (now_ms - F.col("l.at_ms") > ttl)
    return last.select("job", F.when(old, "not_found").otherwise(F.col("l.status")).alias("status"))


def windowed_demand(trips: DataFrame, at: str = "ts", width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Triggers by window and kind, with a watermark for late rows; for streams and batches."""
    return trips.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


class Cached:
    """A DataFrame that is read anew once it is older than ``ttl_s``; the clock is a parameter."""

    def __init__(self, load, ttl_s: float, clock):
        self.load, self.ttl_s, self.clock = load, ttl_s, clock
        self.df, self.at = None, None

    def get(self) -> DataFrame:
        now = self.clock()
        if self.df is None or now - self.at > self.ttl_s:
            if self.df is not None:
                self.df.unpersist()
            self.df, self.at = self.load().persist(), now
        return self.df
