"""Sessions as a stateful stream: each user's open sessions are kept in a state store and leave it by event-time timers.

What a batch query finds by session windows comes out here session by session, once the watermark has passed its end, in whatever order
requests arrive. Requests behind the watermark belong to sessions that may be out already; Spark drops and counts them (see
dropped_rows). Requests that are late by the watermark of one batch but not of the next are taken, as Spark does elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scriptorium.streaming.monitoring import timed

SESSIONS = "user_id long, session_start string, session_end string, requests long, errors long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shown(micros: int) -> str:
    return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def merged(sessions: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """(first, last, requests, errors) in microseconds, in any order -> those no more than `gap` apart as one."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, requests, errors in sorted(sessions):
        if out and first - out[-1][1] <= gap:
            a, b, n, e = out[-1]
            out[-1] = (a, max(b, last), n + requests, e + errors)
        else:
            out.append((first, last, requests, errors))
    return out


class Sessions(StatefulProcessor):
    """State: a list of a user's open sessions, which pauses of more than `gap` part; one timer for each."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, requests long, errors long")

    def _due(self, session: tuple[int, int, int, int]) -> int:
        """When a session can get no more requests, in whole milliseconds."""
        return -(-(session[1] + self.gap) // 1000)

    def _keep(self, before: list[tuple], after: list[tuple]) -> None:
        timers = {self._due(s) for s in after}
        for s in {self._due(x) for x in before} - timers:
            self.handle.deleteTimer(s)
        for s in timers - {self._due(x) for x in before}:
            self.handle.registerTimer(s)
        if after:
            self.open.put(after)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = [tuple(int(x) for x in s) for s in self.open.get()]
        after = before
        for batch in rows:
            new = [(int(t), int(t), 1, int(e)) for t, e in zip(batch["micros"], batch["error"], strict=True)]
            after = merged([*after, *new], self.gap)
        self._keep(before, after)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = [tuple(int(x) for x in s) for s in self.open.get()]
        at = expiredTimerInfo.getExpiryTimeInMs()
        over, after = [s for s in before if self._due(s) <= at], [s for s in before if self._due(s) > at]
        if after:
            self.open.put(after)
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame([(key[0], shown(a), shown(b + self.gap), n, e) for a, b, n, e in over], columns=[c.split()[0] for c in SESSIONS.split(", ")])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB: on the executors' disks, with changes in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def stateful_sessions(events: DataFrame, gap_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """A stream of user_id, session_start, session_end, requests, errors: what monitoring.sessions finds in a table, each once it is over.

    Rows without a time or a user are left out. `late` is the watermark: how long an earlier request may arrive after a later one.
    """
    use_state_store(events.sparkSession)
    rows = timed(events).where("ts is not null and user_id is not null").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("micros"), F.coalesce(F.col("event_type") == "error", F.lit(False)).cast("int").alias("error"))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Sessions(gap_minutes * 60), outputStructType=SESSIONS, outputMode="Append", timeMode="EventTime")


def dropped_rows(query: StreamingQuery) -> int:
    """How many rows the watermark has kept out so far, over the progress that Spark still has."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """The rows in the state store after each batch."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
