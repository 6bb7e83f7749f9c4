"""Event-time windows of a stream: sessions and sliding windows under a watermark, and the rows that come too late for them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import scratch


def silence_sessions(events: DataFrame, key: str, silence: str, late: str) -> DataFrame:
    """key, start, end, n_events, value of a stream of ``events`` (key, ts, value): a session ends when its key is silent for so long, which is its end. It
    comes out (append mode) when the watermark, the newest time less ``late``, has passed that; an event whose own session would have
    ended before the watermark is dropped. Events without a time are in no session."""
    window = F.session_window("ts", silence)
    sessions = events.filter("ts is not null").withWatermark("ts", late).groupBy(key, window.alias("span")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
    return sessions.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n_events", "value")


def sliding_counts(events: DataFrame, key: str, length: str, slide: str, late: str) -> DataFrame:
    """key, start, end, n_events, value: every window of ``length``, one each ``slide``, that has events; it comes out once the watermark has passed its end,
    and an event is dropped from windows that the watermark has passed."""
    windows = events.filter("ts is not null").withWatermark("ts", late).groupBy(key, F.window("ts", length, slide).alias("span")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))
    return windows.select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n_events", "value")


def late_events(events: DataFrame, key: str, silence_ms: int, late: str) -> DataFrame:
    """The rows of a stream of ``events`` that silence_sessions() drops with the same ``late``, and no others, in the batch in which they come. The watermark
    is read from the state's handle; there is no state."""
    names = events.columns
    rows = events.filter("ts is not null").withWatermark("ts", late).withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        for frame in frames:
            yield frame[frame["_ms"] + silence_ms <= passed][names]

    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    return rows.groupBy(key).applyInPandasWithState(run, schema, "nothing int", "append", GroupStateTimeout.NoTimeout)


class Arrivals:
    """A folder that a stream reads, filled by and by, and what the stream has given so far. Each call of add() takes all that has come since as one
    batch, and then lets the watermark go on. All lies in the shared folder, so the stream survives its executors, and goes when the driver ends."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.folder = spark, scratch(spark, "arrivals")
        spark.createDataFrame([], schema).write.parquet(f"{self.folder}/in")  # the source must be there before any row is
        self.stream = spark.readStream.schema(schema).parquet(f"{self.folder}/in")

    def add(self, rows: DataFrame, result: DataFrame) -> None:
        """rows: what arrives now; result: the query over ``stream``, the same in each call."""
        rows.write.mode("append").parquet(f"{self.folder}/in")
        writer = result.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    def given(self, result: DataFrame) -> DataFrame:
        return self.spark.read.schema(result.schema).parquet(f"{self.folder}/out")
