"""Leak-safe splits and samples: hash slots, group splits, sealing, retention, variants, assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.numbering import numbered
from sparkloom.session import shared_folder


def hash_slot(key: Column, version: str = "v1") -> Column:
    """train, dev or sealed (5:2:3) by SHA-256 of version and key, modulo 10.

    16^i is 6 modulo 10 for i of 1 or more, so the remainder follows from the hex digits.
    """
    h = F.sha2(F.concat(F.lit(version + "|"), key), 256)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda k: F.ascii(F.substring(h, k, F.lit(1)))), F.lit(0), lambda s, a: s + F.when(a >= 97, a - 87).otherwise(a - 48))
    last = F.ascii(F.substring(h, 64, 1))
    r = (6 * total + F.when(last >= 97, last - 87).otherwise(last - 48)) % 10
    return F.when(r < 5, "train").when(r < 7, "dev").otherwise("sealed")


def seeded(key: Column, seed: str) -> Column:
    """Order that depends on the seed and the key only."""
    return F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256)


def group_dev(groups: DataFrame, by: str, group: str, share: float = 0.15, seed: str = "dev") -> DataFrame:
    """``dev``: per provenance the first max(1, ceil(share)) groups in seeded order; whole groups only."""
    w = Window.partitionBy(by)
    r = F.row_number().over(w.orderBy(seeded(F.col(group), seed), group))
    return groups.withColumn("dev", r <= F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share)))


def top_up(chosen: DataFrame, labels: DataFrame, group: str, label: str, names: Sequence[str], share: float = 0.15, least: int = 10) -> DataFrame:
    """Greedy pass over labels: add seeded groups until min(least, ceil(share of positives)) positives are in dev. A driver step a label."""
    for name in names:
        rows = labels.where(F.col(label) == name).join(chosen, group)
        total, have = rows.count(), rows.where("dev").count()
        need = min(least, -(-int(total * share * 1000) // 1000)) - have
        if need > 0:
            more = rows.where("NOT dev").select(group).distinct().orderBy(seeded(F.col(group), name), group).limit(need).withColumn("_m", F.lit(True))
            chosen = chosen.join(more, group, "left").withColumn("dev", F.col("dev") | F.coalesce("_m", F.lit(False))).drop("_m")
    return chosen


def ids_sha(ids: DataFrame, key: str) -> DataFrame:
    """Fingerprint of a set of ids: SHA-256 of each one, summed in order-free form, so no id list is gathered."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return ids.agg(F.count("*").alias("n"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("fingerprint"))


def seal_rare_first(candidates: DataFrame, key: str, kind: str, before: Column, target: int = 40, seed: str = "seal") -> DataFrame:
    """Per type the rows sealed before, then seeded ones, up to min(available, target); rarest type has rank 1."""
    w = Window.partitionBy(kind)
    r = F.row_number().over(w.orderBy(before.desc(), seeded(F.col(key), seed), key))
    sized = candidates.withColumns({"_r": r, "available": F.count("*").over(w)}).where(F.col("_r") <= target).drop("_r")
    order = candidates.groupBy(kind).agg(F.count("*").alias("_n")).withColumn("rarity", F.row_number().over(Window.orderBy("_n", kind))).drop("_n")
    return sized.join(F.broadcast(order), kind)


def lost(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sealed before and not now; additions are allowed."""
    return old.select(key).join(new.select(key), key, "left_anti")


def retain_types(spark: SparkSession, moves: DataFrame, labels: DataFrame, comp: str, kind: str, least: int = 30) -> DataFrame:
    """Components to put back: while a move takes a type from ``least`` or more to below, its moved components return.

    Until nothing more returns, which takes a round for each type at most. Only one count a round reaches the driver.
    """
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    enough = labels.groupBy(kind).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(kind)
    moved = moves.select(comp).distinct()
    back = moved.limit(0)
    while True:
        going = moved.join(back, comp, "left_anti")
        left = labels.join(going, comp, "left_anti").groupBy(kind).agg(F.count("*").alias("left"))
        fallen = enough.join(left, kind, "left").where(F.coalesce("left", F.lit(0)) < least).select(kind)
        new = going.join(labels.join(fallen, kind, "left_semi").select(comp).distinct(), comp, "left_semi").checkpoint()
        if new.isEmpty():
            return back
        back = back.unionByName(new)


def variants(df: DataFrame, text: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row a rule and input; a rule that changes nothing gives none."""
    made = df.withColumn("_v", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("variant")) for n, c in rules])))
    return made.select(*df.columns, "_v.rule", "_v.variant").where(F.col("variant") != F.col(text))


def assign_round(rows: DataFrame, key: str, people: Sequence[str], overlap: float, seed: str) -> DataFrame:
    """The first round(n * overlap) rows in seeded order go to everyone, the others in turn, which keeps loads within one."""
    n = rows.count()
    shared = int(n * overlap + 0.5)
    dealt = numbered(rows.select(key, seeded(F.col(key), seed).alias("_s")), [F.col("_s"), F.col(key)], "_r")
    every = F.array(*[F.lit(p) for p in people])
    who = F.when(F.col("_r") <= shared, every).otherwise(F.array(F.element_at(every, ((F.col("_r") - shared - 1) % len(people) + 1).cast("int"))))
    return dealt.select(key, F.explode(who).alias("person"), (F.col("_r") <= shared).alias("shared"))


def water_fill(load: dict[str, int], allowed: Sequence[str], n: int) -> dict[str, int]:
    """How many of ``n`` rows each of the allowed people gets if every row goes to the least loaded one (ties: the first)."""
    order = sorted(allowed, key=lambda p: load[p])
    got, level, k = dict.fromkeys(allowed, 0), load[order[0]], 1
    while n > 0:
        top = load[order[k]] if k < len(order) else None
        room = n if top is None else min(n, (top - level) * k)
        each, more = divmod(room, k)
        raised = [p for p in allowed if p in order[:k]]
        for i, p in enumerate(raised):
            got[p] += each + (i < more)
        n, level = n - room, level + each
        k += 1
    return got


def label_round(rows: DataFrame, key: str, people: Sequence[str], overlap: float, seed: str, gold: str, excluded: str) -> DataFrame:
    """key, person, part of one labelling round.

    ``gold`` rows (boolean) go to everyone. Of the fresh rows the first round(n * overlap) in seeded order go to everyone, the others to the least
    loaded person, which is in turn. Rows with ``excluded`` people (array, not empty), which are looked at again, go to the least loaded of the others: kinds of
    exclusion with the fewest people left first, then by their names. If nobody is left for a row, nothing is assigned.
    Only counts by kind of exclusion, at most 2 to the number of people, reach the driver.
    """
    again = F.coalesce(F.size(F.array_intersect(excluded, F.array(*map(F.lit, people)))), F.lit(0)) > 0
    fresh_or_gold = rows.where(~again)
    nobody = rows.where(F.size(F.array_except(F.array(*map(F.lit, people)), F.coalesce(excluded, F.array().cast("array<string>")))) == 0).count()
    if nobody:
        raise ValueError(f"nobody is left for {nobody} rows")
    of_gold = fresh_or_gold.where(F.coalesce(F.col(gold), F.lit(False))).select(key, F.explode(F.array(*map(F.lit, people))).alias("person"), F.lit("gold").alias("part"))
    fresh = fresh_or_gold.where(~F.coalesce(F.col(gold), F.lit(False)))
    dealt = assign_round(fresh, key, people, overlap, seed).select(key, "person", F.when(F.col("shared"), "shared").otherwise("own").alias("part"))
    n = fresh.count()
    rest = n - int(n * overlap + 0.5)
    load = {p: rest // len(people) + (i < rest % len(people)) for i, p in enumerate(people)}
    kind = F.array_join(F.array_sort(F.array_intersect(excluded, F.array(*map(F.lit, people)))), ",")
    redo = rows.where(again).select(key, kind.alias("_kind"), seeded(F.col(key), seed).alias("_s"))
    counts = {r["_kind"]: r["n"] for r in redo.groupBy("_kind").agg(F.count("*").alias("n")).collect()}
    bounds, free = [], lambda k: [p for p in people if p not in k.split(",")]
    for k in sorted(counts, key=lambda k: (len(free(k)), k)):
        upto = 0
        for p, m in water_fill(load, free(k), counts[k]).items():
            if m:
                bounds.append((k, upto, upto + m, p))
            load[p] += m
            upto += m
    table = rows.sparkSession.createDataFrame(bounds, "_kind string, _from long, _to long, person string")
    placed = numbered(redo, [F.col("_s"), F.col(key)], "_r", by=["_kind"])
    given = placed.join(F.broadcast(table), "_kind").where("_r > _from AND _r <= _to").select(key, "person", F.lit("again").alias("part"))
    return of_gold.unionByName(dealt).unionByName(given)


def audit_pick(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.select(key).orderBy(seeded(F.col(key), seed), key).limit(n)
