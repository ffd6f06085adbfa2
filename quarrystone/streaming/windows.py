"""Event streams: watermarked windows, sessions, duplicates and per-key state. On bounded input they equal the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per key and tumbling or sliding window; `late` sets the watermark on a stream."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: its events with gaps shorter than `gap`."""
    e = events.withWatermark(ts, late) if late and events.isStreaming else events
    return e.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def first_deliveries(events: DataFrame, ts: str, id_: str, late: str) -> DataFrame:
    """Each id once; on a stream, repeats within the watermark are dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_]) if events.isStreaming else events.dropDuplicates([id_])


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far, kept as state per key and emitted whenever the key has new events."""
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into an in-memory table and returns it; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
