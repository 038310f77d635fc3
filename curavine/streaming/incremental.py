"""Incremental processing: watermarks by key, processed sets, feeds and idempotent sinks on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import last_per_key
from ..sources.files import exists


def new_since(rows: DataFrame, state: DataFrame, key: str, time: str, watermark: str = "watermark") -> DataFrame:
    """Rows later than their key's watermark; keys without one and rows without a time all count."""
    j = rows.join(state.select(key, watermark), key, "left")
    return j.where(F.col(watermark).isNull() | F.col(time).isNull() | (F.col(time) > F.col(watermark))).drop(watermark)


def raise_watermarks(rows: DataFrame, state: DataFrame, key: str, time: str, watermark: str = "watermark") -> DataFrame:
    """Each key's greatest time so far."""
    new = rows.groupBy(key).agg(F.max(time).alias(watermark))
    return state.select(key, watermark).unionByName(new).groupBy(key).agg(F.max(watermark).alias(watermark))


def not_processed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    return rows.join(processed.select(key), key, "left_anti")


def processed_with(processed: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The processed keys and those seen now, each once; empty ones don't count."""
    return processed.select(key).unionByName(seen.select(key)).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()


def watch_feed(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    """Hands each new file of a feed's folder to a function, exactly once for each batch number."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def feed_changed(old: DataFrame, new: DataFrame, time: str = "generatedAt", count: str = "n") -> bool:
    """Whether a feed's one-row summary differs in time or count from the one before."""
    a, b = old.select(time, count).first(), new.select(time, count).first()
    return b is not None and a != b


def upsert_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the last row of each key counts. Versions are named after batches, so a batch that
    is handed over again after a failure writes what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/b{number - 1}"
        own = last_per_key(batch, key, order)
        if number > 0 and exists(spark, before):
            own = spark.read.schema(batch.schema).parquet(before).join(own.select(key), key, "left_anti").unionByName(own)
        own.write.mode("overwrite").parquet(f"{path}/b{number}")

    return write


def once_per_key(stream: DataFrame, key: str) -> DataFrame:
    """Each key's first row only, over the whole life of the stream."""
    return stream.dropDuplicates([key])


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows per key and time window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
