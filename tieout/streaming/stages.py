"""How long each stage of a run takes, kept up while the run is going on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tieout.vocab import RUN_STATES, TERMINAL_STATES

OUTPUT = "run_id string, state string, millis bigint"
# State with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StageClock(StatefulProcessor):
    """Holds when a run was first seen in each state, at most a row for each state there is.

    A row that comes late moves a stage's beginning back and with it the end of the stage before. When the watermark
    has passed the run's last row by `keep_ms`, the run is forgotten.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, read and written once a micro-batch: each call to the store goes through a socket.
        self.held = handle.getValueState("held", "last bigint, timer bigint, states array<string>, micros array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        last, timer, states, times = held if held is not None else (None, None, [], [])
        first, changed = dict(zip(states, times, strict=True)), False
        for batch in rows:
            for state, micros in zip(batch["state"].tolist(), batch["micros"].tolist(), strict=True):
                if isinstance(state, str) and micros == micros and (state not in first or micros < first[state]):
                    first[state] = int(micros)
                    changed = True
            latest = int(batch["micros"].max())
            last = latest if last is None else max(last, latest)
        ends = max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.held.update((last, ends, list(first), list(first.values())))
        if changed:
            ended = stage_rows(key[0], first)
            yield pd.DataFrame({"run_id": [row[0] for row in ended], "state": [row[1] for row in ended],
                                "millis": pd.array([row[2] for row in ended], dtype="Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"run_id": pd.Series([], dtype=str), "state": pd.Series([], dtype=str), "millis": pd.Series([], dtype="Int64")})

    def close(self) -> None:
        pass


def stage_rows(run_id: str, first: dict[str, int]) -> list[tuple]:
    """(run_id, state, millis) of the stages seen so far; the last one has no end yet.

    The queue is never announced; it starts with the run where normalising bounds it.
    """
    known = dict(first)
    if "normalising" in known and "queued" not in known:
        known["queued"] = min(known.values())
    rank = {state: min(i, len(RUN_STATES) - 2) for i, state in enumerate(RUN_STATES)}
    order = sorted(known, key=lambda s: rank[s])
    ends = [known[s] // 1000 for s in order[1:]] + [None]
    return [(run_id, s, None if end is None else end - known[s] // 1000)
            for s, end in zip(order, ends, strict=True) if s not in TERMINAL_STATES]


def live_stage_durations(trace: DataFrame, keep_ms: int, delay: str) -> DataFrame:
    """(run_id, state, millis) of every run that a micro-batch changed; of each stage the last row holds."""
    trace.sparkSession.conf.set(*STORE)
    rows = trace.withWatermark("at", delay).select("run_id", "state", F.unix_micros("at").alias("micros"), "at")
    return rows.groupBy("run_id").transformWithStateInPandas(
        StageClock(keep_ms), OUTPUT, outputMode="Update", timeMode="EventTime")
