"""Operations analytics: shares, filtered counts, zone buckets, zero-filled axes, periods, paging, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def kst() -> Column:
    return F.expr("INTERVAL 9 HOURS")


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each key; an empty total counts as 1."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1))
    return counts.withColumn("pct", F.round(F.col("n") * 100 / total, 1))


def local_bucket(ts: Column, unit: str) -> Column:
    """Start of the unit in the fixed +9 hour zone. Weeks start on Monday."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, ts + kst())


def axis(df: DataFrame, first: Column, last: Column, unit: str) -> DataFrame:
    """One row a bucket from the first to the last, from a one-row frame."""
    return df.select(F.explode(F.sequence(F.date_trunc(unit, first), F.date_trunc(unit, last), F.expr(UNITS[unit]))).alias("bucket"))


def zero_filled(axis_: DataFrame, counts: DataFrame, *measures: str) -> DataFrame:
    return axis_.join(counts, "bucket", "left").select("bucket", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def period_over_period(df: DataFrame, ts: Column, now: Column, length: str) -> DataFrame:
    """Counts in the half-open interval that ends now and in the one of equal length before it."""
    span = F.expr(length)
    return df.agg(F.count_if((ts >= now - span) & (ts < now)).alias("current"), F.count_if((ts >= now - span - span) & (ts < now - span)).alias("previous"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of rows with the total; a number beyond the last page gives the last."""
    total = df.count()
    last = max(1, -(-total // size))
    at = min(max(1, number), last)
    return df.orderBy(*order).offset((at - 1) * size).limit(size).withColumns({"page": F.lit(at), "pages": F.lit(last), "total": F.lit(total).cast("long")})


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def repeated_recent(df: DataFrame, owner: str, kind: str, order: Sequence[Column], window: int = 10, least: int = 3) -> DataFrame:
    """Kinds with at least ``least`` rows among each owner's most recent ``window`` rows."""
    recent = df.withColumn("_n", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("_n") <= window)
    return recent.groupBy(owner, kind).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def status_case(disabled: Column, last: Column, created: Column, now: Column, days: int = 365) -> Column:
    return F.when(disabled, "disabled").when(F.coalesce(last, created) < now - F.make_dt_interval(F.lit(days)), "dormant").otherwise("active")


def k_anonymous(df: DataFrame, keys: Sequence[str], least: int = 20) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def nearest_rank(column: str, q: int) -> Column:
    """The ceil(n q / 100)-th smallest value."""
    return F.expr(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY {column})").cast("double")
