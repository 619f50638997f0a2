"""Distributed numbering against windows over all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators.numbering import numbered, running
from tests.compare import rows_of


def same(a, b):
    assert rows_of(a.columns, [tuple(r) for r in a.collect()]) == rows_of(b.columns, [tuple(r) for r in b.collect()])


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), "n_chars")


def test_running_total_in_groups(docs):
    w = Window.partitionBy("lang")
    upto = F.sum("n_chars").over(w.orderBy(F.desc("n_chars"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = running(docs, [F.desc("n_chars"), F.col("doc_id")], "p", by=["lang"], weight="n_chars", total="t")
    same(got, docs.select("*", (upto - F.col("n_chars")).alias("p"), F.sum("n_chars").over(w).alias("t")))


def test_numbers_without_groups(docs):
    got = numbered(docs, [F.desc("n_chars"), F.col("doc_id")], "p", parts=7)
    same(got, docs.select("*", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("p")))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_rows_and_one_value(spark, docs):
    assert numbered(docs.limit(0), [F.col("doc_id")], "p", by=["lang"]).count() == 0
    assert running(docs.limit(0), [F.col("doc_id")], "p", weight="n_chars").count() == 0
    equal = spark.range(500).select(F.lit(None).cast("string").alias("g"), F.lit(1).alias("x"))
    got = numbered(equal, [F.col("x")], "p", by=["g"]).select("p")
    assert sorted(r.p for r in got.collect()) == list(range(1, 501))
