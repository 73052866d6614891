"""Structured Streaming forms of the stateful behaviours. Each function takes a streaming (or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events by type in windows of one width; what comes later than allowed is not counted.

    Late is judged by the watermark of the batch before: an event that comes in the batch right after the one that moves
    the watermark past its window is still counted, from the second batch on it is dropped."""
    g = _timed(events, ts, late).groupBy(F.window("_ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    g = _timed(events, ts, late).groupBy(F.window("_ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A user's events with less than the gap between them."""
    g = _timed(events, ts, late).groupBy(F.session_window("_ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "user_id", "n")


def once(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark: the state holds the keys of that time only."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def into_table(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str], accept: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge each micro-batch into a versioned parquet table by key, the last by ``order`` winning.

    Versions are numbered by batch, so that a batch repeated after a failure writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = incremental.latest(accept(batch) if accept else batch, keys, order)
        if number:
            new = incremental.upsert(spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
