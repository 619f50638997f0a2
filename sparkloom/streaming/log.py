"""Error-log sink: bounded buffers that count what they drop, batches of bounded size, idempotent writes, and a compaction that purges.

A log folder holds generations and batches: ``gen=<n>`` is the compacted state, ``batch=<b>`` what came since, and ``CURRENT`` names the generation and the last
batch it contains. Readers take that generation and later batches only, so a compaction that dies midway is not seen, and one that is repeated overwrites itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class Buffer(StatefulProcessor):
    """Of each key and interval the first ``capacity`` rows pass, the rest are dropped and counted. Counts are state that expires ``keep_ms`` after its last change.

    Rows of one micro-batch come in order of (ts, id), so a batch that is replayed passes the same rows. A batch's rows of an interval are held in a heap of at most
    ``capacity``.
    """

    def __init__(self, fields: list[str], ts: str, key: str, capacity: int, every: str, keep_ms: int):
        self.fields, self.ts, self.key, self.capacity, self.every, self.keep_ms = fields, ts, key, capacity, every, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "interval timestamp", "passed long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first: dict[pd.Timestamp, list] = {}
        came: dict[pd.Timestamp, int] = {}
        for part in rows:
            part = part.assign(_interval=part[self.ts].dt.floor(self.every))
            for interval, own in part.groupby("_interval"):
                heap = first.setdefault(interval, [])
                came[interval] = came.get(interval, 0) + len(own)
                own = own.nsmallest(self.capacity, [self.ts, self.key], keep="first") if len(own) > self.capacity else own
                for row in own[self.fields].itertuples(index=False, name=None):
                    at, ident = row[self.fields.index(self.ts)], row[self.fields.index(self.key)]
                    item = (-at.value, -ident, row)  # the largest of those that are held is on top
                    if len(heap) < self.capacity:
                        heapq.heappush(heap, item)
                    elif item[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, item)
        for interval in sorted(first):
            state = (interval.to_pydatetime(),)
            passed = self.counts.getValue(state)[0] if self.counts.containsKey(state) else 0
            taken = sorted(first[interval], key=lambda x: (-x[0], -x[1]))[: max(0, self.capacity - passed)]
            dropped = came[interval] - len(taken)
            if taken:
                self.counts.updateValue(state, (passed + len(taken),))
            rest = [tuple(interval if c == self.ts else None for c in self.fields) + (dropped,)] if dropped else []
            made = [(*x[2], 0) for x in taken] + rest
            # plain objects: text columns that pandas keeps in Arrow chunks cannot be sent
            out = pd.DataFrame({c: pd.Series([r[i] for r in made], dtype=object) for i, c in enumerate([*self.fields, "dropped"])})
            yield out.assign(**{self.ts: pd.to_datetime(out[self.ts])}, **{f"_k{i}": pd.Series([k] * len(out), dtype=object) for i, k in enumerate(key)})

    def close(self) -> None:
        pass


def buffered(stream: DataFrame, by: list[str], ts: str, key: str, capacity: int, every: str = "1D", keep_days: int = 90) -> DataFrame:
    """The rows that pass, with ``dropped`` 0, and for each key and interval of a batch one row without them, with how many were ``dropped``.

    ``by`` should hold a shard of the rows' ids, so that no key holds a large part of the stream. ``key`` is a number that names a row.
    """
    fields = [c for c in stream.columns if c not in by]
    kinds = [T.StructField(c, stream.schema[c].dataType) for c in fields] + [T.StructField("dropped", T.LongType())] + [T.StructField(f"_k{i}", stream.schema[c].dataType) for i, c in enumerate(by)]
    made = stream.groupBy(*by).transformWithStateInPandas(Buffer(fields, ts, key, capacity, every, keep_days * DAY_MS), T.StructType(kinds), "append", "processingTime")
    return made.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], *fields, "dropped")


# ---------------------------------------------------------------- the folder


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> tuple[int, int]:
    """(generation, last batch in it); (-1, -1) before the first compaction."""
    fs, p = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(p):
        return -1, -1
    gen, batch = spark.read.text(f"{path}/CURRENT").first()[0].split()
    return int(gen), int(batch)


def numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def run_log(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 100) -> None:
    """Write what ``buffered`` gives, a folder a batch, in files of at most ``rows_per_file`` rows; a batch that is repeated overwrites its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id > current(batch.sparkSession, path)[1]:  # else it is in the generation already
            batch.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/batch={batch_id}")

    spark = stream.sparkSession
    # state that expires by the clock would ask for batches without data for ever
    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def log_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the current generation and of later batches; ``_batch`` is the batch a row came with."""
    gen, last = current(spark, path)
    out = spark.read.schema(T.StructType([*schema, T.StructField("_batch", T.LongType())])).parquet(f"{path}/gen={gen}") if gen >= 0 else None
    for b in numbers(spark, path, "batch"):
        if b > last:
            some = spark.read.schema(schema).parquet(f"{path}/batch={b}").withColumn("_batch", F.lit(b).cast("long"))
            out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], T.StructType([*schema, T.StructField("_batch", T.LongType())]))


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, by: list[str], ts: str, keep_days: int = 90, every: str = "day") -> None:
    """A new generation: of each ``key`` its row of the last batch, drop counts summed, nothing older than ``keep_days`` before the newest row. What it replaces is deleted."""
    gen, last = current(spark, path)
    new = [b for b in numbers(spark, path, "batch") if b > last]
    if not new:
        return
    rows = log_rows(spark, path, schema)
    newest = rows.agg(F.max(ts).alias("_newest"))
    kept = rows.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.make_dt_interval(F.lit(keep_days))).drop("_newest")
    names = [f.name for f in schema]
    whole = kept.where("dropped = 0").groupBy(key).agg(F.max(F.struct("_batch", *[n for n in names if n != key])).alias("_m"))
    whole = whole.select(*[F.col(n) if n == key else F.col(f"_m.{n}").alias(n) for n in names], "_m._batch")
    counts = kept.where("dropped > 0").groupBy(*by, F.date_trunc(every, ts).alias(ts)).agg(F.sum("dropped").alias("dropped"), F.max("_batch").alias("_batch"))
    counts = counts.select(*[F.col(n) if n in (*by, ts, "dropped") else F.lit(None).cast(schema[n].dataType).alias(n) for n in names], "_batch")
    whole.unionByName(counts).write.mode("overwrite").parquet(f"{path}/gen={gen + 1}")
    fs, p = _fs(spark, f"{path}/CURRENT.new")
    out = fs.create(p, True)
    out.write(bytearray(f"{gen + 1} {new[-1]}\n".encode()))
    out.close()
    target = _fs(spark, f"{path}/CURRENT")[1]
    fs.delete(target, False)
    fs.rename(p, target)
    for b in new:
        fs.delete(_fs(spark, f"{path}/batch={b}")[1], True)
    if gen >= 0:
        fs.delete(_fs(spark, f"{path}/gen={gen}")[1], True)
