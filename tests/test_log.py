"""The error-log sink over many batches: drops are counted, a replay changes nothing, compaction purges and keeps files few."""

import datetime
import glob
import os

from pyspark.sql import functions as F

from sparkloom.streaming import events as E
from sparkloom.streaming import log as L

DAY = datetime.datetime(2024, 1, 1)


def test_batches_replay_and_compaction(spark, tmp_path):
    batches = [  # (id, days, text): two a day pass for each level
        [(1, 0.1, "a"), (2, 0.2, "b"), (3, 0.3, "c"), (4, 1.0, "d")],
        [(5, 0.4, "late"), (6, 1.1, "e"), (7, 1.2, "f"), (4, 1.0, "d")],
        [(8, 30.0, "g")],
        [(9, 31.0, "h"), (10, 31.1, "i"), (11, 31.2, "j")],
    ]
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(i, "warn", DAY + datetime.timedelta(days=t), x) for i, t, x in rows], "id long, level string, ts timestamp, text string")
        made.coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
        os.utime(glob.glob(f"{tmp_path}/in/{k}.parquet/part*")[0], (1_700_000_000 + k, 1_700_000_000 + k))
    schema = spark.read.parquet(f"{tmp_path}/in/0.parquet").schema
    stream = lambda: L.buffered(E.read_stream(spark, f"{tmp_path}/in/*.parquet", schema, 1), ["level"], "ts", "id", 2)
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    L.run_log(stream(), out, cp)
    kind = stream().schema

    def state():
        rows = L.log_rows(spark, out, kind).collect()
        return sorted(r.id for r in rows if not r.dropped), sum(r.dropped for r in rows)

    # day 0: 1, 2 pass, 3 and the late 5 are dropped; day 1: 4, then 6 or the repeated 4 fill it
    assert state() == ([1, 2, 4, 4, 8, 9, 10], 1 + 1 + 2 + 1)
    last = max(int(os.path.basename(x)) for x in glob.glob(f"{cp}/commits/[0-9]*"))
    before = state()
    os.remove(f"{cp}/commits/{last}")  # the last batch was written, but its commit was lost: it comes again
    crc = f"{cp}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    L.run_log(stream(), out, cp)
    assert state() == before
    L.compact(spark, out, kind, "id", ["level"], "ts", 10)
    assert state() == ([8, 9, 10], 1)  # of the repeated id one row, nothing older than ten days
    assert not glob.glob(f"{out}/batch=*") and len(glob.glob(f"{out}/gen=*")) == 1
    L.run_log(stream(), out, cp)  # nothing new
    L.compact(spark, out, kind, "id", ["level"], "ts", 10)
    assert state() == ([8, 9, 10], 1)
    more = spark.createDataFrame([(12, "warn", DAY + datetime.timedelta(days=60), "k")], schema)
    more.coalesce(1).write.parquet(f"{tmp_path}/in/9.parquet")
    L.run_log(stream(), out, cp)
    L.compact(spark, out, kind, "id", ["level"], "ts", 10)
    assert state() == ([12], 0) and L.current(spark, out)[0] == 1
    assert len(glob.glob(f"{out}/gen=*")) == 1


def test_unfinished_compaction_is_not_seen(spark, tmp_path):
    kind = "id long, level string, ts timestamp, dropped long"
    rows = spark.createDataFrame([(1, "x", DAY, 0)], kind)
    out = f"{tmp_path}/out"
    rows.write.parquet(f"{out}/batch=0")
    rows.withColumn("_batch", F.lit(0).cast("long")).write.parquet(f"{out}/gen=0")  # died before CURRENT was written
    assert L.log_rows(spark, out, rows.schema).count() == 1
    L.compact(spark, out, rows.schema, "id", ["level"], "ts")
    assert L.log_rows(spark, out, rows.schema).count() == 1 and L.current(spark, out) == (0, 0)
    assert L.log_rows(spark, f"{tmp_path}/none", rows.schema).count() == 0
