"""Sources: declared inputs that must exist, editions, paged collections, page lines, box-drawing tables, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

READERS = {"parquet", "json", "csv", "text", "orc"}


def scan(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Read a declared input. A missing path or a file set without rows stops; it never is an empty relation."""
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind!r}")
    df = spark.read.format(kind).options(**options).load(path)
    if df.isEmpty():
        raise ValueError(f"input {path} has no rows")
    return df


def editions(df: DataFrame, path: str = "path", allow: bool = False) -> DataFrame:
    """The original file wins; an edition (``name__cYYYYMMDD``) counts only where no original exists, and only if allowed."""
    base = F.regexp_replace(path, r"__c[0-9]{8}", "")
    edition = F.col(path).rlike(r"__c[0-9]{8}")
    if not allow and not df.where(edition).isEmpty():
        raise ValueError("editions are present and not allowed")
    w = Window.partitionBy("_base").orderBy("_edition", path)
    return df.withColumns({"_base": base, "_edition": edition.cast("int")}).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_base", "_edition", "_n")


def page_completeness(df: DataFrame, page: str, declared: Column) -> DataFrame:
    """Rows and distinct rows against the declared total; duplicates that make up the number are not complete."""
    row = F.struct(*[c for c in df.columns if c != page])
    counted = df.agg(declared.alias("declared"), F.count("*").alias("rows"), F.countDistinct(row).alias("distinct_rows"), F.countDistinct(page).alias("pages"))
    return counted.withColumn("complete", (F.col("rows") == F.col("declared")) & (F.col("distinct_rows") == F.col("declared")))


def ledger_last(df: DataFrame, key: str, seq: str, values: Sequence[str]) -> DataFrame:
    """The last row of each path; of rows with one sequence number the largest."""
    return df.groupBy(key).agg(F.max(F.struct(seq, *values)).alias("_r")).select(key, "_r.*")


def html_lines(html: Column) -> Column:
    out = F.regexp_replace(html, "<(script|style)[^>]*>[^<]*</", "</")
    out = F.regexp_replace(out, "<br[^>]*>|</(p|li|h1|div|article)>", "\n")
    return F.split(F.trim(F.regexp_replace(out, "<[^>]*>", "")), "\n")


def fields(lines: Column) -> Column:
    """Map of ``key : value`` lines; of repeated keys the first."""
    pairs = F.filter(lines, lambda s: s.rlike(r"^[^:]+:"))
    keys = F.transform(pairs, lambda s: F.trim(F.substring_index(s, ":", 1)))
    return F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.trim(F.regexp_replace(F.element_at(F.filter(pairs, lambda p: F.trim(F.substring_index(p, ":", 1)) == k), 1), r"^[^:]+:", "")).alias("value")))


def box_rows(text: str) -> list[tuple[list[str], bool]]:
    """Logical rows of a table drawn with ``|`` and rule lines: (cells, irregular). Lines of a row join cell by cell without a space."""
    rows: list[list[str]] = []
    fresh = True
    for line in text.split("\n"):
        s = line.strip()
        if s and set(s) <= set("-+=|─┼├┤┌┐└┘┬┴│ ") and not s.replace("|", "").replace("│", "").strip() == "":
            fresh = True
            continue
        if "|" not in s and "│" not in s:
            fresh = True
            continue
        cells = [c.strip() for c in s.replace("│", "|").strip("|").split("|")]
        if fresh or not rows or len(cells) != len(rows[-1]):
            rows.append(cells)
            fresh = False
        else:
            rows[-1] = [a + b for a, b in zip(rows[-1], cells, strict=True)]
    width = max((len(r) for r in rows), default=0)
    return [(r, len(r) != width) for r in rows]


@F.udtf(returnType=T.StructType([T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("irregular", T.BooleanType())]))
class BoxTable:
    """UDTF form of :func:`box_rows`."""

    def eval(self, text: str):
        for k, (cells, odd) in enumerate(box_rows(text or "")):
            yield k, cells, odd
