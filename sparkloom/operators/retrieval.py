"""Hybrid retrieval: terms, lexical and vector branches, reciprocal-rank fusion, diversity, per-partition limits, quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.numbering import numbered

RRF_K, CAP, POOL, MIN_STEM = 60, 2, 50, 2
#: Our own endings and function words, longest ending first.
ENDINGS = ("ation", "ing", "ed", "es", "s")
FUNCTION_WORDS = ("the", "and", "of", "to", "in", "is", "a")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """One ending less, longest first, if ``MIN_STEM`` characters stay."""
    out = word
    for e in reversed(ENDINGS):
        out = F.when(word.endswith(e) & (F.length(word) - len(e) >= MIN_STEM), F.substring(word, 1, F.length(word) - len(e))).otherwise(out)
    return out


def query_terms(text: Column) -> Column:
    """Stemmed distinct terms in first-seen order; function words are dropped. Empty if nothing is left."""
    kept = F.filter(words(text), lambda w: ~w.isin(*FUNCTION_WORDS))
    return F.array_distinct(F.transform(kept, stem))


def lexical_scores(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Rows with at least one word that starts with a term; ``matched`` distinct terms, ``tf`` all hits. No terms: no rows."""
    if not terms:
        return docs.limit(0).withColumns({"matched": F.lit(0), "tf": F.lit(0)})
    # the lambdas bind the words, then the hits, so a text is cut into words once, and the filter stays above the generator
    begins = lambda t: lambda w: w.startswith(t)
    hits = F.transform(F.array(words(F.col(text))), lambda own: F.array(*[F.size(F.filter(own, begins(t))) for t in terms]))
    found = F.transform(hits, lambda h: F.struct(F.size(F.filter(h, lambda n: n > 0)).alias("matched"), F.aggregate(h, F.lit(0), lambda s, n: s + n).alias("tf")))
    return docs.select("*", F.inline(found)).where("matched > 0")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_distances(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine distance (rounded to 6 places) of each vector to the one query row; refuses other widths by giving null."""
    q = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))
    same = F.size("embedding") == F.size("_q")
    return vectors.crossJoin(q).withColumn("distance", F.when(same, F.round(1 - cosine(F.col("embedding"), F.col("_q")), 6))).drop("_q")


def ranked(df: DataFrame, order: Sequence[Column], rank: str, limit: int | None = None) -> DataFrame:
    """Global rank by a total order: of the first ``limit`` rows, cut by a distributed top-k, or of all rows, numbered in ranges."""
    if not limit:
        return numbered(df, order, rank)
    return df.orderBy(*order).limit(limit).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each partition; the same order inside as outside."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def fuse(left: DataFrame, right: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``rank_l`` and ``rank_r``; a side that lacks the key adds nothing."""
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return left.join(right, key, "full_outer").withColumn("rrf", F.round(part("rank_l") + part("rank_r"), 9))


def diversify(df: DataFrame, group: str, order: Sequence[Column], cap: int = CAP, pool: bool = False) -> DataFrame:
    """``place``: the first ``cap`` rows of each group keep their order, the others move behind in theirs.

    ``pool`` says that the rows are a list cut to a size that one task holds; else groups and places are numbered in ranges, whatever their size.
    """
    if pool:
        within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return df.withColumn("_late", (within > cap).cast("int")).withColumn("place", F.row_number().over(Window.orderBy("_late", *order))).drop("_late")
    late = numbered(df, order, "_within", by=[group]).withColumn("_late", (F.col("_within") > cap).cast("int"))
    return numbered(late.drop("_within"), [F.col("_late"), *order], "place").drop("_late")


def law_view(left: DataFrame, right: DataFrame, key: str, where: Column, order_l: Sequence[Column], order_r: Sequence[Column]) -> DataFrame:
    """Filter first, then rank again, then fuse: ranks are those of the filtered lists."""
    return fuse(ranked(left.where(where), order_l, "rank_l").select(key, "rank_l"), ranked(right.where(where), order_r, "rank_r").select(key, "rank_r"), key)


def pick_distinct(df: DataFrame, coord: Sequence[str], order: Sequence[Column], own: Column, k: int) -> DataFrame:
    """Each coordinate once at its first place, its own row preferred; cut to k after that. Places are numbered in ranges."""
    first = numbered(df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in coord])), order, "_r")
    best = first.groupBy(*coord).agg(F.min("_r").alias("_first"), F.min(F.struct((-own.cast("int")).alias("o"), "_r")).alias("_b"))
    kept = first.join(best.select("_first", F.col("_b._r").alias("_r")), "_r")
    return numbered(kept, [F.col("_first")], "pick").where(F.col("pick") <= k).drop("_r", "_first")


def rank_quality(found: DataFrame, k: int) -> DataFrame:
    """One row of named denominators: queries, in_pool, in_top, first, mrr. found: one row a query, ``rank`` null where missed."""
    r = F.col("rank")
    return found.agg(
        F.count("*").alias("queries"), F.count("rank").alias("in_pool"), F.count_if(r <= k).alias("in_top"), F.count_if(r == 1).alias("first"),
        F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"),
    )
