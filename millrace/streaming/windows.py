"""Structured Streaming over event tables: windows, sessions, dedup, stateful thresholds.

Each function takes a DataFrame, batch or streaming, so that a stream and its batch
twin are the same expression; run() drains a stream into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.session import importable

LATE = "31 days"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder (or one file) as micro-batches."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    # watermarks need a time with a zone; times without one are in the session's
    return reader.option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row of each (user_id, event_type, hour), whatever arrives again within the watermark."""
    hour = events.withColumn("hour", F.date_trunc("hour", "ts"))
    keys = ["user_id", "event_type", "hour"]
    if events.isStreaming:
        return hour.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys).select(*keys)
    return hour.select(*keys).distinct()


class RunningThreshold(StatefulProcessor):
    """A lane's keep threshold: the percentile of its last scores, kept as bounded state."""

    def __init__(self, buffer: int = 64, warm: int = 8, percentile: float = 60.0):
        self.buffer, self.warm, self.percentile = buffer, warm, percentile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import numpy as np

        past = [r[0] for r in self.scores.get()] if self.scores.exists() else []
        out = []
        for frame in rows:
            for event_id, value in frame.sort_values("event_id")[["event_id", "value"]].itertuples(index=False):
                thr = float(np.percentile(past[-self.buffer:], self.percentile)) if len(past) >= self.warm else None
                out.append((key[0], int(event_id), thr))
                past = (past + [float(value)])[-self.buffer:]
        self.scores.put([(x,) for x in past])
        yield pd.DataFrame(out, columns=["event_type", "event_id", "thr"])

    def close(self) -> None:
        pass


def running_threshold(events: DataFrame) -> DataFrame:
    """(event_type, event_id, thr) with state carried from batch to batch."""
    importable(events.sparkSession)
    return events.groupBy("event_type").transformWithStateInPandas(
        statefulProcessor=RunningThreshold(), outputStructType="event_type string, event_id long, thr double", outputMode="Append", timeMode="None"
    )


def run(stream: DataFrame, folder: str, mode: str = "complete", write: Callable | None = None) -> DataFrame:
    """Drain what is available and return the result table.  folder holds offsets and state: a
    later run goes on from there, so what is written by batch id is written once."""
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if write is not None:
        writer.foreachBatch(write).start().awaitTermination()
        return spark.range(0).toDF("id")
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def idempotent_append(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a replayed batch overwrites instead of doubling."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
