"""Streaming over event files: micro-batched sink with retention, running counters, windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 4) -> DataFrame:
    """File stream of Parquet; the batch size is bounded by files, so a backlog cannot flood a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there as Parquet, then stop. The checkpoint makes a restart continue where it ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def keep_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", change=None) -> None:
    """Each micro-batch is written to a folder of its own batch id, so a repeated batch overwrites itself. ``change`` may thin it out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of all batches, of rows with equal keys that of the last batch (within a batch, the largest row)."""
    rest = [c for c in columns if c not in keys]
    last = spark.read.parquet(path).groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_m"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in columns])


def upserting_sink(stream: DataFrame, path: str, checkpoint: str, keep_days: int = 90, ts: str = "ts") -> None:
    """Batches without rows that are past retention already; :func:`retained` reads them."""

    def recent(batch: DataFrame) -> DataFrame:
        newest = batch.agg(F.max(ts).alias("_newest"))
        return batch.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(keep_days))).drop("_newest")

    keep_batches(stream, path, checkpoint, change=recent)


def retained(spark: SparkSession, path: str, key: str, columns: list[str], keep_days: int = 90, ts: str = "ts") -> DataFrame:
    """The sink's rows: the last of each key over all batches, and of those the ones within ``keep_days`` of the newest."""
    rows = merged(spark, path, [key], columns)
    newest = spark.read.parquet(path).agg(F.max(ts).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(keep_days))).drop("_newest")


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling event-time windows; events later than the watermark are dropped, state behind it is released."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def running_counters(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))
