"""Positions and running totals in a total order, without gathering rows in one task.

Rows are dealt by range of the order and written down; each range counts for itself, and what lies before a range is added from a
table of one row a range (and group). So no window holds more than a range, whatever the number of rows and however large one group is.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import shared_folder

#: monotonically_increasing_id puts the partition's number above this bit and the row's number in the partition below it.
PART_BIT = 33


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table of its own in the shared folder: later jobs read it, none computes it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer partitions, as a small table in one file does; else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def running(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = (), weight: str | None = None, total: str | None = None, parts: int | None = None, write=written) -> DataFrame:
    """``df`` with ``name``: how many rows (or how much ``weight``, not null) of its group ``by`` stand before the row.

    ``order`` must be total for the numbers of equal rows to be reproducible; rows that are equal in it are numbered as they come.
    ``total`` names a column for the group's whole count or weight. Null is a group like others. ``write`` cuts the lineage.
    """
    spark = df.sparkSession
    n = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*[F.col(c) for c in by], *order]
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_nr_id", F.monotonically_increasing_id())
    laid = write(laid).withColumn("_nr_part", F.shiftright("_nr_id", PART_BIT))
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    sums = laid.groupBy("_nr_part", *by).agg(F.sum(one).alias("_nr_sum"), F.min("_nr_id").alias("_nr_first"))
    if by:
        group = Window.partitionBy(*by)
        sums = sums.withColumns({"_nr_all": F.sum("_nr_sum").over(group), "_nr_before": F.sum("_nr_sum").over(group.orderBy("_nr_part")) - F.col("_nr_sum")})
    else:  # a row a range
        rows, before = sorted(sums.select("_nr_part", "_nr_sum", "_nr_first").collect()), 0
        made = []
        for part, s, first in rows:
            made.append((part, s, first, 0, before))
            before += s
        sums = spark.createDataFrame([(p, s, f, before, b) for p, s, f, _, b in made], "_nr_part long, _nr_sum long, _nr_first long, _nr_all long, _nr_before long")
    if weight is None:
        inside = F.col("_nr_id") - F.col("_nr_first")
    else:
        own = Window.partitionBy("_nr_part", *by).orderBy("_nr_id")
        laid = laid.withColumn("_nr_own", F.sum(weight).over(own) - F.col(weight))
        inside = F.col("_nr_own")
    right = sums.select(*[F.col(c).alias(f"_nr_r{c}") for c in ("_nr_part", *by)], "_nr_first", "_nr_all", "_nr_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_nr_r{c}")) for c in by], F.col("_nr_part") == F.col("_nr_r_nr_part"))
    out = laid.join(right if by else F.broadcast(right), same)  # without groups: a row a range
    added = {name: F.col("_nr_before") + inside}
    if total:
        added[total] = F.col("_nr_all")
    return out.select(*df.columns, *[c.alias(k) for k, c in added.items()])


def numbered(df: DataFrame, order: Sequence[Column], name: str, **options) -> DataFrame:
    """``name``: 1 for the first row of the order (or of its group), and so on."""
    out = running(df, order, name, **options)
    return out.withColumn(name, F.col(name) + 1)
