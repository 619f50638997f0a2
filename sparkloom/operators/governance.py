"""Governed loads: permission joins, upserts, sweeps, ratchets, reconciliation, diffs, set operations."""

from __future__ import annotations

import re

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def governed(facts: DataFrame, permissions: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Inner join on permission: a missing permission row makes the fact disappear (fail closed)."""
    return facts.join(permissions.where(allowed).select(key).distinct(), key, "left_semi")


def flag_exists(facts: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """EXISTS as a boolean column; no row is false, never null."""
    hit = other.select(key).distinct().withColumn(name, F.lit(True))
    return facts.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def optional_set(column: Column, wanted: Sequence[str], known: Sequence[str]) -> Column:
    """An empty set admits all; an unknown value raises before any query."""
    if unknown := set(wanted) - set(known):
        raise ValueError(f"unknown values {sorted(unknown)}")
    return column.isin(*wanted) if wanted else F.lit(True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Natural-key upsert; doing it twice changes nothing."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` to add: key not stored yet, each key once; null keys are always inserted."""
    some = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*new.columns)
    return some.unionByName(new.where(F.col(key).isNull()))


def orphans(stored: DataFrame, declared: DataFrame, keys: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Stored rows that are not declared. An empty declaration and a loss above ``limit`` refuse."""
    if declared.isEmpty():
        raise ValueError("an empty declaration never deletes")
    gone = stored.join(declared.select(*keys), list(keys), "left_anti")
    if limit < 1.0:
        total, lost = stored.count(), gone.count()
        if lost > limit * total:
            raise ValueError(f"{lost} of {total} rows would go")
    return gone


def readback_diff(stored: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose counts differ between what is stored and what was to be."""
    both = stored.select(*keys, F.lit(1).alias("_s"), F.lit(None).cast("int").alias("_e")).unionByName(expected.select(*keys, F.lit(None).cast("int").alias("_s"), F.lit(1).alias("_e")))
    # one grouping of both sides: null keys meet, and nothing is joined
    j = both.groupBy(*keys).agg(F.sum("_s").alias("n_stored"), F.sum("_e").alias("n_expected"))
    return j.where(~F.col("n_stored").eqNullSafe(F.col("n_expected")))


def shrinkage(old: DataFrame, new: DataFrame, layer: str, limit: float = 0.05) -> DataFrame:
    """Layers that lost more than ``limit`` of their rows; a vanished layer counts as 0; growth is ignored."""
    a, b = old.groupBy(layer).agg(F.count("*").alias("before")), new.groupBy(layer).agg(F.count("*").alias("after"))
    j = a.join(b, layer, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return j.where(F.col("before") - F.col("after") > limit * F.col("before"))


def carry_over(fresh: DataFrame, filled: DataFrame, key: str, human: Sequence[str]) -> DataFrame:
    """New sheet with the human-filled columns of the old one; a filled row that would be lost stops."""
    lost = filled.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in human])).join(fresh, key, "left_anti")
    if not lost.isEmpty():
        raise ValueError("filled rows would be lost")
    return fresh.join(filled.select(key, *[F.col(c).alias(f"_{c}") for c in human]), key, "left").select(*[c for c in fresh.columns if c not in human], *[F.coalesce(f"_{c}", c).alias(c) for c in human])


def reconcile(ledger: DataFrame, disk: DataFrame, key: str, causes: Sequence[tuple[str, Column]]) -> DataFrame:
    """Full outer join by path with the first cause that fits. Both sides have ``sha``; causes may use ``ledger_sha`` and ``disk_sha``."""
    j = ledger.withColumnRenamed("sha", "ledger_sha").join(disk.withColumnRenamed("sha", "disk_sha"), key, "full_outer")
    state = F.when(F.col("disk_sha").isNull(), "missing").when(F.col("ledger_sha").isNull(), "added").when(F.col("ledger_sha") != F.col("disk_sha"), "changed").otherwise("same")
    cause = F.lit(None).cast("string")
    for name, holds in reversed(causes):
        cause = F.when(holds, name).otherwise(cause)
    return j.withColumn("state", state).withColumn("cause", F.when(F.col("state") == "missing", F.coalesce(cause, F.lit("other"))))


def missing_causes(ledger: DataFrame, disk: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """path, cause of every ledger row whose path is not on disk; both sides have path, sha, size.

    The first that holds: ``moved`` (its hash lies on disk under another path), ``excluded`` (a declared pattern fits its path), ``cleared`` (nothing of its folder is
    left), ``replaced`` (its folder has a file of its size that the ledger does not know), else ``lost``. Hashes, folders and sizes meet as distinct keys.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    gone = ledger.select("path", "sha", "size", folder.alias("folder")).join(disk.select("path"), "path", "left_anti")
    here = disk.select("path", "sha", "size", folder.alias("folder"))
    elsewhere = here.select("sha").where("sha IS NOT NULL").distinct().withColumn("_moved", F.lit(True))
    folders = here.select("folder").distinct().withColumn("_folder", F.lit(True))
    unknown = here.join(ledger.select("path"), "path", "left_anti").select("folder", "size").distinct().withColumn("_same", F.lit(True))
    j = gone.join(elsewhere, "sha", "left").join(folders, "folder", "left").join(unknown, ["folder", "size"], "left")
    declared = F.lit(False)
    for pattern in excluded:
        declared = declared | F.col("path").rlike(glob_pattern(pattern))
    cause = F.when(F.col("_moved"), "moved").when(declared, "excluded").when(F.col("_folder").isNull(), "cleared").when(F.col("_same"), "replaced").otherwise("lost")
    return j.select("path", cause.alias("cause"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", glob)) + "$"


def run_delta(old: DataFrame, new: DataFrame, key: str, amount: str) -> DataFrame:
    """One row: documents added, gone, changed; amounts of both runs; what of their difference comes from documents that came or went, and what from those in both."""
    j = old.select(key, F.col(amount).alias("a"), F.lit(1).alias("_a")).join(new.select(key, F.col(amount).alias("b"), F.lit(1).alias("_b")), key, "full_outer")
    only_a, only_b = F.col("_b").isNull(), F.col("_a").isNull()
    both = ~only_a & ~only_b
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return j.agg(
        F.count_if(only_b).alias("added"), F.count_if(only_a).alias("gone"), F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        total("a", F.lit(True)).alias("old_total"), total("b", F.lit(True)).alias("new_total"),
        (total("b", only_b) - total("a", only_a)).alias("source_caused"), (total("b", both) - total("a", both)).alias("rule_caused"),
    )


def run_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: only_a, only_b, and for each field the number of rows in both that changed."""
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("_a")).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("_b")), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = [F.count_if(both & ~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"changed_{f}") for f in fields]
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), *changed)


def class_moves(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    j = a.select(key, F.col(field).alias("was")).join(b.select(key, F.col(field).alias("now")), key).where(~F.col("was").eqNullSafe(F.col("now")))
    return j.groupBy("was", "now").agg(F.count("*").alias("n"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("only_a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b")))


def union_with_provenance(parts: dict[str, DataFrame], known: Sequence[str]) -> DataFrame:
    if unknown := set(parts) - set(known):
        raise ValueError(f"unknown lineage {sorted(unknown)}")
    return reduce(lambda x, y: x.unionByName(y), [df.withColumn("provenance", F.lit(k)) for k, df in parts.items()])


def fold_short(df: DataFrame, group: str, order: str, short: Column, text: str) -> DataFrame:
    """Short rows join the text of the nearest earlier row that is not short; leading short rows stay."""
    w = Window.partitionBy(group).orderBy(order)
    parent = F.coalesce(F.last(F.when(~short, F.col(order)), ignorenulls=True).over(w), F.col(order))
    g = df.withColumn("_p", parent).groupBy(group, F.col("_p").alias(order)).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_s"), F.count("*").alias("parts"))
    return g.select(group, order, "parts", F.array_join(F.transform("_s", lambda s: s[text]), " ").alias(text))


def order_breaks(df: DataFrame, group: Sequence[str], order: str, ordinal: str) -> DataFrame:
    """Rows whose ordinal does not grow, and ``blocked`` for every row of such a group."""
    w = Window.partitionBy(*group).orderBy(order, ordinal)
    broken = F.coalesce(F.col(ordinal) <= F.lag(ordinal).over(w), F.lit(False))
    return df.withColumn("broken", broken).withColumn("blocked", F.max("broken").over(Window.partitionBy(*group)))


def nearest_ancestor(nodes: DataFrame, group: str, path: str, marked: Column) -> DataFrame:
    """For each node the longest proper path prefix among the marked nodes of its group."""
    anc = nodes.where(marked).select(group, F.col(path).alias("_a"))
    prefixes = nodes.withColumn("_a", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, r"\.")) - 1, F.lit(1))), lambda k: F.array_join(F.slice(F.split(path, r"\."), 1, k), "."))))
    hits = prefixes.where(F.col("_a") != F.col(path)).join(anc, [group, "_a"]).groupBy(group, path).agg(F.max_by("_a", F.length("_a")).alias("ancestor"))
    return nodes.join(hits, [group, path], "left")


def split_in_force(df: DataFrame, name: str, today: Column, allow: Sequence[str] = ()) -> DataFrame:
    """``pending`` where the date in the file name lies ahead, unless allowed; a name without a date gives null."""
    day = F.to_date(F.nullif(F.regexp_extract(name, "([0-9]{8})", 1), F.lit("")), "yyyyMMdd")
    return df.withColumn("pending", F.when(day.isNull(), None).otherwise((day > today) & ~F.col(name).isin(*allow) if allow else day > today))


def conflicts(a: DataFrame, b: DataFrame, key: str, sha: str) -> DataFrame:
    return a.select(key, F.col(sha).alias("ours")).join(b.select(key, F.col(sha).alias("theirs")), key).where("ours <> theirs")


def bundle_sha(df: DataFrame, group: Sequence[str], name: Column, sha: Column) -> DataFrame:
    """Twelve hex digits over the name-sorted (name, digest) lines of each set."""
    lines = F.array_sort(F.collect_list(F.concat(name, F.lit(" "), sha)))
    return df.groupBy(*group).agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 12).alias("bundle"), F.count("*").alias("files"))
