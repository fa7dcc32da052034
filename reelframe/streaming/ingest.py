"""Frame streams: features as they arrive, segments once a job has ended.

Adaptive thresholds need a job's whole distribution, so segments can't be decided frame by frame.
The stream keeps, per job, only the previous frame's signal as state and writes deltas; segments are
then found from the stored deltas of ended jobs by the batch operators. With ``late``, the state of a
job goes once the watermark has passed its last event by ``idle`` milliseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELTA_SCHEMA = "job long, idx long, ts timestamp, value double, change double"
STATE_SCHEMA = "idx long, value double"


def stream_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_deltas(events: DataFrame, scale: float = 500.0, late: str | None = None, idle: int = 3_600_000) -> DataFrame:
    """Change of each event's value against the previous event of its job, across micro-batches.

    A job's events of one micro-batch are ordered as a whole, by time and, where there is one, event_id.
    """
    order = ["ts", "event_id"] if "event_id" in events.columns else ["ts"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        idx, value = state.get if state.exists else (0, None)
        rows, last = [], None
        for r in pd.concat(list(parts)).sort_values(order, kind="stable").itertuples():
            rows.append((key[0], idx, r.ts, r.value, None if value is None else abs(r.value - value) / scale))
            idx, value, last = idx + 1, r.value, r.ts
        if rows:
            state.update((idx, value))
            if late:
                state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle)
        yield pd.DataFrame(rows, columns=["job", "idx", "ts", "value", "change"])

    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy("job").applyInPandasWithState(step, DELTA_SCHEMA, STATE_SCHEMA, "append", timeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Frames and rejected frames of each job and window, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "job").agg(F.count("*").alias("n"), F.count_if("rejected").alias("n_rejected"))


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
