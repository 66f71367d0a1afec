"""Run progress as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tieout.session import new_folder
from tieout.vocab import TERMINAL_STATES

STATE_SCHEMA = "state string, event_id long, at timestamp"
OUTPUT_SCHEMA = "run_id string, state string, at timestamp, event_id long, timed_out boolean"


def distinct_states(trace: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each (run, state) once, however often the trace repeats it."""
    return trace.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "state"])


def _advance(silence_ms: int | None, key: tuple, batches: Iterator[pd.DataFrame],
             state: GroupState) -> Iterable[pd.DataFrame]:
    """Emit the transitions of one run; after a terminal state nothing more.

    A run that stays silent for too long is reported failed.
    """
    columns = ["run_id", "state", "at", "event_id", "timed_out"]
    held = state.get if state.exists else None
    if state.hasTimedOut:
        state.update(("failed", held[1], held[2]))
        yield pd.DataFrame([(key[0], "failed", held[2], held[1], True)], columns=columns)
        return
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    out = []
    for row in rows.itertuples(index=False):
        if held is not None and (held[0] in TERMINAL_STATES or held[0] == row.state):
            continue
        held = (row.state, int(row.event_id), row.at)
        out.append((key[0], row.state, row.at, int(row.event_id), False))
    state.update(held)
    if silence_ms is not None and held[0] not in TERMINAL_STATES:
        last = int(rows["at"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + silence_ms)
    if out:
        yield pd.DataFrame(out, columns=columns)


def transitions(trace: DataFrame, silence_ms: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Live state machine per run over (run_id, state, at, event_id).

    With `silence_ms`, a run without an ending is failed once the watermark is that far
    past its last event.
    """
    timeout = GroupStateTimeout.NoTimeout
    if silence_ms is not None:
        trace, timeout = trace.withWatermark("at", delay), GroupStateTimeout.EventTimeTimeout
    return trace.groupBy("run_id").applyInPandasWithState(
        partial(_advance, silence_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read the result as a table."""
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-marks")
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_counts(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run a stream of counts over what its source holds now and read the counts as they stand at the end.

    Every micro-batch writes the counts it changed, open windows too, into a folder of its own, so that a
    batch that is run again writes the same one; of each key the last batch's count holds.
    """
    spark = stream.sparkSession
    out, marks = new_folder(spark, label), new_folder(spark, f"{label}-marks")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.option("checkpointLocation", marks).outputMode("update").trigger(availableNow=True)
             .foreachBatch(write).start())
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    held = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    return held.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(*keys, "last.*")


def last_states(rows: DataFrame) -> DataFrame:
    """From the emitted transitions: where each run stands."""
    return rows.groupBy("run_id").agg(F.max_by("state", F.struct("at", "event_id")).alias("state"),
                                      F.count("*").alias("transitions"))
