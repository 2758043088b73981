"""Structured Streaming forms of the stateful patterns: exactly-once work per key, and the latest state of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.relations import pending


def latest_states(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The newest value of each key of a stream, by event order; for update or complete output."""
    return events.groupBy(key).agg(F.max(F.struct(order, value)).alias("_last"), F.count("*").alias("n_events")).select(key, F.col(f"_last.{value}").alias(value), "n_events")


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts by key and time window; rows later than the watermark are dropped by the engine, as asked."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def settle_once(planned: DataFrame, stored_path: str, keys: list[str], work, checkpoint: str) -> StreamingQuery:
    """Runs `work` (DataFrame to DataFrame) on planned rows whose keys aren't stored yet and appends the results: a restarted query
    repeats no key that was stored."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            todo = pending(df.dropDuplicates(keys), spark.read.parquet(stored_path), keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = df.dropDuplicates(keys)
        work(todo).write.mode("append").parquet(stored_path)

    return planned.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
