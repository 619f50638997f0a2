"""Masking of names by a declared policy: ordered axes for each source, counts as the only ledger, and an audit of what is left.

The order is part of the contract: anchors (the row's own name, longest variant first), persons, names that the text declares by a legal form (harvested before they are
replaced), such slots, foreign slots, bare mentions of the harvested names (longest first), an alias in parentheses behind a mask, addresses, brands. Anchors are exact and go
first; persons are broad and follow them; harvesting must see names that slots will hide. A source without a policy stops: nothing passes unmasked by omission.

All of it are Column expressions: a text is masked where it lies, and a document's harvested names are an array in its own row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("org", "person", "addr", "brand")
#: Our own small forms. A name is one to three capitalised words.
NAME = r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,2}"
FORMS = r"(?:Ltd|Inc|LLC|Group)"
FOREIGN = r"(?:GmbH|SARL|S\.L\.)"
PERSON = r"(?:Mr|Ms|Dr)\. [A-Z][a-z]+"
ADDRESS = r"[0-9]+ [A-Z][a-z]+ (?:Street|Road|Avenue)"
BRAND = r"[A-Z][A-Za-z]+®"
ALIAS = r"\[org\] \([A-Za-z ]+\)"
RESIDUE = {"org": f"{NAME} {FORMS}|{NAME} {FOREIGN}|{ALIAS}", "person": PERSON, "addr": ADDRESS, "brand": BRAND}


def longest_first(names: Column) -> Column:
    keyed = F.transform(F.array_distinct(names), lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))
    return F.filter(F.transform(F.array_sort(keyed), lambda s: s["n"]), lambda n: F.length(n) >= 3)


def replace_all(text: Column, names: Column, mark: str) -> Column:
    return F.aggregate(names, text, lambda t, n: F.replace(t, n, F.lit(mark)))


def harvest(text: Column) -> Column:
    """Names that the text declares by a legal form, longest first."""
    found = lambda forms: F.regexp_extract_all(text, F.lit(f"({NAME}) {forms}"), F.lit(1))
    return longest_first(F.concat(found(FORMS), found(FOREIGN)))


def variants(anchor: Column) -> Column:
    """The anchor and its form without the legal form, longest first; none without an anchor."""
    return longest_first(F.array_compact(F.array(anchor, F.regexp_replace(anchor, f" {FORMS}$| {FOREIGN}$", ""))))


def mask(df: DataFrame, text: str, anchor: str, source: str, policy: Mapping[str, Sequence[str]]) -> DataFrame:
    """``df`` with ``masked``, ``counts`` (struct of the four axes: marks that were set) and ``left`` (struct of the declared axes' residues)."""
    unknown = {a for axes in policy.values() for a in axes} - set(AXES)
    if unknown:
        raise ValueError(f"unknown axes: {', '.join(sorted(unknown))}")
    of = lambda names: reduce(lambda a, b: a | b, [F.col(source).eqNullSafe(s) for s in names], F.lit(False))
    stray = df.where(~of(policy)).select(source).limit(1).collect()
    if stray:
        raise ValueError(f"source {stray[0][0]!r} has no masking policy")
    on = lambda axis: of([s for s, axes in policy.items() if axis in axes])
    step = lambda d, axis, c: d.withColumn("masked", F.when(on(axis), c).otherwise(F.col("masked")))
    t = F.col("masked")
    out = df.withColumn("masked", F.coalesce(F.col(text), F.lit("")))
    out = step(out, "org", replace_all(t, variants(F.col(anchor)), "[org]"))
    out = step(out, "person", F.regexp_replace(t, PERSON, "[person]"))
    out = out.withColumn("_names", harvest(t))
    out = step(out, "org", F.regexp_replace(t, f"{NAME} {FORMS}", "[org]"))
    out = step(out, "org", F.regexp_replace(t, f"{NAME} {FOREIGN}", "[org]"))
    out = step(out, "org", replace_all(t, F.col("_names"), "[org]")).drop("_names")
    out = step(out, "org", F.regexp_replace(t, ALIAS, "[org]"))
    out = step(out, "addr", F.regexp_replace(t, ADDRESS, "[addr]"))
    out = step(out, "brand", F.regexp_replace(t, BRAND, "[brand]"))
    marks = lambda a: ((F.length(t) - F.length(F.replace(t, F.lit(f"[{a}]"), F.lit("")))) / (len(a) + 2)).cast("int")
    left = lambda a: F.when(on(a), F.size(F.regexp_extract_all(t, F.lit(f"({RESIDUE[a]})"), F.lit(1)))).otherwise(0)
    return out.withColumns({"counts": F.struct(*[marks(a).alias(a) for a in AXES]), "left": F.struct(*[left(a).alias(a) for a in AXES])})
