"""Rows of paths are dealt over partitions that grow with the input, and keep their suffixes."""

import re

from pyspark.sql import functions as F

from sparkloom.operators import outline as O


def test_partitions_grow_and_one_exchange_deals_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "PART_BYTES", 1 << 16)
    rows = spark.range(60_000).select((F.col("id") / 6).cast("long").alias("doc"), (F.col("id") % 6).alias("seq"), F.element_at(F.array(*map(F.lit, ["1", "1.1", "1", "1.1", "2", "2.1"])), (F.col("id") % 6 + 1).cast("int")).alias("path"))
    assert O.parts_for(rows) > 16
    out = O.unique_paths(rows, "doc", "seq", "path")
    got = {tuple(r) for r in out.where("doc = 7").select("seq", "unique_path").collect()}
    assert got == {(0, "1~1"), (1, "1~1.1~1"), (2, "1~2"), (3, "1~2.1~2"), (4, "2"), (5, "2.1")}
    assert out.count() == 60_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange.*ENSURE_REQUIREMENTS", plan)
