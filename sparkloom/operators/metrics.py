"""Evaluation: precision, recall, F1, averages with a measurability floor, Wilson intervals, kappa, agreement, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURABLE = 30


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(pred: DataFrame, gold: DataFrame, row: str, kind: str) -> DataFrame:
    """Per kind tp, fp, fn, precision, recall, f1; kinds that only predictions have count their false positives."""
    p, g = pred.select(row, kind).distinct().withColumn("_p", F.lit(1)), gold.select(row, kind).distinct().withColumn("_g", F.lit(1))
    j = p.join(g, [row, kind], "full_outer")
    c = j.groupBy(kind).agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def averages(scores: DataFrame, least: int = MEASURABLE) -> DataFrame:
    """Macro over measurable kinds (at least ``least`` in gold), micro over all."""
    enough = F.col("tp") + F.col("fn") >= least
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return scores.agg(
        F.round(F.avg(F.when(enough, F.col("f1"))), 6).alias("macro_f1"), F.count_if(enough).alias("measurable"), F.count_if(~enough).alias("unmeasurable"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("micro_f1"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share, clipped to [0, 1]; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = n > 0
    return F.when(ok, F.round(F.greatest(F.lit(0.0), mid - half), 6)), F.when(ok, F.round(F.least(F.lit(1.0), mid + half), 6))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa over rows that both have labelled; null where chance agreement is 1."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    share = lambda c, name: both.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(name))
    pe = share(a, "na").join(share(b, "nb"), "v").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("cross"))
    j = n.crossJoin(pe)  # one row each
    po, pc = F.col("same") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return j.select("n", F.round(po, 6).alias("po"), F.round(pc, 6).alias("pe"), F.when(pc < 1, F.round((po - pc) / (1 - pc), 6)).alias("kappa"))


def agreement(answers: DataFrame, item: str, labels: str, outside: str) -> DataFrame:
    """agreed, partial or split of the label sets of an item's annotators; ``outside`` never mixes with labels."""
    g = answers.groupBy(item).agg(F.collect_list(labels).alias("_l"))
    first = F.element_at("_l", 1)
    common = F.aggregate("_l", first, F.array_intersect)
    every = F.array_distinct(F.flatten("_l"))
    out = F.exists("_l", lambda x: F.array_contains(x, outside))
    all_out = F.forall("_l", lambda x: F.array_contains(x, outside))
    state = F.when(out, F.when(all_out, "agreed").otherwise("split")).when(F.size(common) == F.size(every), "agreed").when(F.size(common) > 0, "partial").otherwise("split")
    return g.select(item, F.size("_l").alias("annotators"), state.alias("state"))


def group_prf(rows: DataFrame, pred: str, gold: str, members: Sequence[str]) -> DataFrame:
    """Row-level hit if any member of the group is in both sets."""
    group = F.array(*[F.lit(m) for m in members])
    p, g = F.arrays_overlap(pred, group), F.arrays_overlap(gold, group)
    hit = F.arrays_overlap(F.array_intersect(pred, gold), group)
    c = rows.agg(F.count_if(hit).alias("tp"), F.count_if(p & ~hit).alias("fp"), F.count_if(g & ~hit).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6)})


def best_alternative(pred: Column, alternatives: Column) -> Column:
    """The alternative gold set with the largest overlap, the first on ties."""
    scored = F.transform(alternatives, lambda a, i: F.struct(F.size(F.array_intersect(a, pred)).alias("n"), (-i).alias("i"), a.alias("set")))
    return F.array_max(scored)["set"]


def matched_threshold(scores: DataFrame, label: str, score: str, gold: str, base_recall: float, grid: Sequence[float], least: int = 10) -> DataFrame:
    """Per label the highest grid threshold whose recall is at least ``base_recall``; fewer than ``least`` positives: 0.5."""
    counts = scores.groupBy(label).agg(F.count_if(F.col(gold) == 1).alias("pos"), *[F.count_if((F.col(gold) == 1) & (F.col(score) >= t)).alias(f"_t{i}") for i, t in enumerate(grid)])
    best = F.greatest(*[F.when(F.col(f"_t{i}") >= base_recall * F.col("pos"), F.lit(t)) for i, t in enumerate(grid)], F.lit(None).cast("double"))
    return counts.select(label, "pos", F.when(F.col("pos") < least, 0.5).otherwise(best).alias("threshold"))


def sweep(scores: DataFrame, score: str, gold: str, grid: Sequence[float]) -> DataFrame:
    """Per threshold: detected, missed, lawful rows flagged, quiet rows. The grid is exploded after one pass of counting per score step."""
    rows = scores.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in grid])))
    hit, bad = F.col(score) >= F.col("threshold"), F.col(gold) == 1
    return rows.groupBy("threshold").agg(F.count_if(hit & bad).alias("detected"), F.count_if(~hit & bad).alias("missed"), F.count_if(hit & ~bad).alias("flagged"), F.count_if(~hit & ~bad).alias("quiet"))


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each step, in one pass."""
    held, counts = F.lit(True), []
    for name, keep in steps:
        held = held & F.coalesce(keep, F.lit(False))
        counts.append(F.struct(F.lit(len(counts)).alias("step"), F.lit(name).alias("name"), F.count_if(held).alias("n")))
    return df.agg(F.array(*counts).alias("s")).select(F.inline("s"))
