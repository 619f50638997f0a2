"""Queries of streaming (B08, J01, J03, J04): the stream is run over the events to its end, then compared as a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.session import shared_folder
from sparkloom.streaming import events as E
from sparkloom.streaming import log as L


def _work(spark: SparkSession) -> str:
    """A folder for this run below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


def _stream(spark: SparkSession, d: str):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a pattern, as a stream takes no single file
    return E.read_stream(spark, f"{d}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_stream_window(spark, d):
    """Tumbling days by event time. Windows are given out when they change, to files; state behind the watermark is released."""
    work = _work(spark)
    counts = E.windowed_counts(_stream(spark, d), "ts", "event_type").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    E.keep_batches(counts, f"{work}/out", f"{work}/cp", "update")
    return E.merged(spark, f"{work}/out", ["day", "event_type"], ["day", "event_type", "n", "total"])


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def events_batch_sink(spark, d):
    """Micro-batches through foreachBatch: the last row of an event over all batches, with retention of 20 days."""
    work = _work(spark)
    E.upserting_sink(_stream(spark, d), f"{work}/out", f"{work}/cp", 20)
    return E.retained(spark, f"{work}/out", "event_id", ["event_id", "user_id", "event_type", "ts"], 20).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def events_running_counters(spark, d):
    work = _work(spark)
    E.keep_batches(E.running_counters(_stream(spark, d), ["event_type"]), f"{work}/out", f"{work}/cp", "update")
    return E.merged(spark, f"{work}/out", ["event_type"], ["event_type", "n"])


@query("""WITH r AS (SELECT *, date_trunc('day', ts) AS d, row_number() OVER (PARTITION BY event_type, event_id % 4, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
    cut AS (SELECT max(ts) - INTERVAL 20 DAY AS c FROM r WHERE n <= 5),
    p AS (SELECT event_type, d, count(*) AS passed FROM r, cut WHERE n <= 5 AND ts >= c GROUP BY 1, 2),
    x AS (SELECT event_type, d, count(*) AS dropped FROM r, cut WHERE n > 5 AND d >= c GROUP BY 1, 2)
    SELECT event_type, strftime(d, '%Y-%m-%d') AS day, coalesce(passed, 0) AS passed, coalesce(dropped, 0) AS dropped FROM p FULL OUTER JOIN x USING (event_type, d)""")
def error_log_sink(spark, d):
    """Events as log records: 5 a day pass for each type and shard, the others are counted; compacted with a retention of 20 days."""
    work = _work(spark)
    rows = _stream(spark, d).select("event_id", "ts", "event_type", (F.col("event_id") % 4).alias("shard"))
    log = L.buffered(rows, ["event_type", "shard"], "ts", "event_id", 5)
    L.run_log(log, f"{work}/log", f"{work}/cp")
    L.compact(spark, f"{work}/log", log.schema, "event_id", ["event_type", "shard"], "ts", 20)
    kept = L.log_rows(spark, f"{work}/log", log.schema)
    return kept.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("dropped") == 0).alias("passed"), F.sum("dropped").alias("dropped"))
