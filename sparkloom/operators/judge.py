"""Judgment over synthetic rule tables: cascade, floors, ratchet, premises, records, routing, contracts.

Risk is three-valued: an unknown floor is null and never the lowest. Rule tables are small DataFrames and are broadcast by the planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.automaton import phrases_in
from sparkloom.operators.numbering import written

R0, R1, R2, R3 = range(4)


def verdict(scanned: Column, strong: Column, demoted: Column, caution: Column, typed: Column, reasoned: Column, based: Column, lawless: Column) -> Column:
    """The per-sentence cascade in its declared order: struct of verdict and reason.

    strong, demoted: counts of hits; typed, reasoned, based: the hits have a type, a reason class, a basis; lawless: a typed hit cites no law.
    """
    out = lambda v, r=None: F.struct(F.lit(v).alias("verdict"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(~scanned, out("unjudged"))
        .when((strong == 0) & (demoted == 0) & caution, out("confirmed", "not_claim"))
        .when((strong > 0) & ~typed, out("hold", "low_conf"))
        .when((strong > 0) & ~reasoned, out("hold", "low_conf"))
        .when((strong > 0) & ~based, out("no_basis"))
        .when(strong > 0, out("confirmed", "hit"))
        .when(lawless, out("no_basis"))
        .otherwise(out("hold", "low_conf"))
    )


def floors(hits: DataFrame, rules: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """floor, ceiling of each hit (columns id, keys, code). rules: keys, code (null for the whole type), cover, risk, family.

    For types with sub-items (``family``): no rule of the law and type gives R1 if the law has any rule, else unknown; rules that cover all of
    the cited codes give the floor, partial ones a ceiling above it; without either the highest of the others is the ceiling.
    Other types: the highest rule, or unknown.
    """
    k = list(keys)
    mine = rules.groupBy(*k).agg(F.max("risk").alias("top"), F.max("family").alias("family"))
    law = rules.groupBy(k[0]).agg(F.lit(True).alias("law_known")).distinct()
    by_code = rules.where(F.col(code).isNotNull()).groupBy(*k, code).agg(F.max(F.when(F.col("cover") == "all", F.col("risk"))).alias("full"), F.max(F.when(F.col("cover") == "partial", F.col("risk"))).alias("part"))
    j = hits.join(mine, k, "left").join(law, k[0], "left").join(by_code, [*k, code], "left")
    known = F.coalesce("law_known", F.lit(False))
    base = F.coalesce("full", F.lit(R1))
    in_family = F.coalesce("family", F.col("sub_items"))
    floor = F.when(in_family, F.when(~known, None).otherwise(base)).otherwise(F.col("top"))
    other = F.when(F.col("full").isNull() & (F.col("top") > R1), F.col("top"))
    ceiling = F.when(in_family & known, F.when(F.col("part").isNotNull(), F.when(F.col("part") > base, F.col("part"))).otherwise(other))
    return j.select(*hits.columns, floor.cast("int").alias("floor"), ceiling.cast("int").alias("ceiling"))


def combine_floors(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Any unknown makes the whole unknown; else floor is the maximum, ceiling the highest above it."""
    g = found.groupBy(*by).agg(F.bool_or(F.col("floor").isNull()).alias("_u"), F.max("floor").alias("_f"), F.max("ceiling").alias("_c"))
    return g.select(*by, F.when(~F.col("_u"), F.col("_f")).alias("floor"), F.when(~F.col("_u") & (F.col("_c") > F.col("_f")), F.col("_c")).alias("ceiling"))


def ratchet(floor: Column, encoder: Column) -> Column:
    """Highest of the floor and the encoder's risk, which counts up to R1; null if both are."""
    return F.greatest(floor, F.when(encoder.isNotNull(), F.least(encoder, F.lit(R1))))


def premise_branches(sentences: DataFrame, premises: DataFrame, category: str) -> DataFrame:
    """Each sentence under each premise of its category; an unknown category takes every premise. premises is a small table."""
    fits = F.col(category).isNull() | (F.col(category) == F.col("of_category"))
    return sentences.join(premises, fits)


def recorded(branches: DataFrame, sentence: str) -> DataFrame:
    """Conservative record: confirmed only if every branch confirms the same non-empty set, else hold; risk is the highest.

    branches: sentence, verdict, violations (sorted array), risk. A sentence without any confirmed violation keeps ``unchanged``.
    """
    hit = (F.col("verdict") == "confirmed") & (F.size("violations") > 0)
    g = branches.groupBy(sentence).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.countDistinct(F.when(hit, F.array_join("violations", ","))).alias("kinds"),
        F.max(F.when(hit, F.col("risk"))).alias("risk"), F.max_by(F.array_join("violations", ","), F.struct(F.when(hit, F.col("risk")), F.array_join("violations", ","))).alias("worst"),
    )
    same = (F.col("hits") == F.col("n")) & (F.col("kinds") == 1)
    return g.select(sentence, F.when(F.col("hits") == 0, "unchanged").when(same, "confirmed").otherwise("hold").alias("record"), F.when(F.col("hits") > 0, F.col("risk")).alias("risk"), F.when(F.col("hits") > 0, F.col("worst")).alias("violations"))


def folded(branches: DataFrame, sentence: str) -> DataFrame:
    """Branches with equal results fold into one, with their premises."""
    key = F.concat_ws("|", "verdict", F.array_join("violations", ","), F.col("risk").cast("string"))
    return branches.groupBy(sentence, key.alias("result")).agg(F.array_sort(F.collect_set("premise")).alias("premises"))


def route(sentences: DataFrame, doc: str) -> DataFrame:
    """hold > certificate > guidance > passed. sentences: doc, verdict, violations, risk, reason_class, not_claim, category."""
    viol = F.size("violations") > 0
    g = sentences.groupBy(doc).agg(
        F.bool_or(F.col("verdict") != "confirmed").alias("open"), F.bool_or(viol & F.col("risk").isNull()).alias("unknown"),
        F.bool_or(viol & F.col("reason_class").isin("A", "C")).alias("ac"), F.bool_or(viol & (F.col("reason_class") == "B")).alias("b"),
        F.bool_or(F.col("not_claim") & F.col("category").isNull()).alias("quiet"),
    )
    outcome = F.when(F.col("open") | F.col("unknown"), "hold").when(F.col("ac"), "certificate").when(F.col("b"), "guidance").when(F.col("quiet"), "hold").otherwise("passed")
    return g.select(doc, outcome.alias("outcome"))


def upsert_sentences(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str], order: str) -> DataFrame:
    """Replace in place, append what is new behind, keep the order."""
    o, n = old.select(key, F.col(order).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in cols]), new.select(key, F.col(order).alias("_n"), *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_has"))
    most = old.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_most"))  # one row
    j = o.join(n, key, "full_outer").crossJoin(F.broadcast(most))
    return j.select(key, *[F.when(F.col("_has"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in cols], F.coalesce(F.col("_o"), F.col("_n") + F.col("_most")).alias(order))


def breaches(df: DataFrame, row: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule: a breach is data, not an exception. A null condition does not hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), r) for r, c in rules.items()]))
    return df.select(*row, F.explode(broken).alias("rule_id"))


def over_threshold(scores: Column, thresholds: Sequence[float], names: Sequence[str]) -> Column:
    """Labels whose probability reaches their threshold; lengths that differ give null, which the contract check reports."""
    pairs = F.transform(scores, lambda p, i: F.struct(p.alias("p"), F.element_at(F.array(*[F.lit(t) for t in thresholds]), i + 1).alias("t"), F.element_at(F.array(*[F.lit(n) for n in names]), i + 1).alias("name")))
    return F.when(F.size(scores) == len(thresholds), F.transform(F.filter(pairs, lambda x: x["p"] >= x["t"]), lambda x: x["name"]))


def carry_forward(df: DataFrame, doc: str, order: str, head: Column, default: str) -> DataFrame:
    """Disposition of each clause: that of the last head clause before it (or its own), else the default."""
    from pyspark.sql import Window

    return df.withColumn("disposition", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order)), F.lit(default)))


def _implies(when: Column, then: Column) -> Column:
    """Unknown premises ask for nothing; unknown conclusions are breaches."""
    return ~F.coalesce(when, F.lit(False)) | F.coalesce(then, F.lit(False))


def sentence_contract() -> dict[str, Column]:
    """Rules that a judged sentence must meet, for ``breaches``.

    Columns: verdict, hold_reason, n_violations, infeasibility, n_evidence, risk, encoder, encoder_basis, not_claim, n_spans, subst_cap (risk at
    most if substantiated), fact_kind and fact_cap (the open question and the risk at most if true), answered (kinds of facts already answered),
    subst_answered.
    """
    c = F.col
    confirmed, hold = c("verdict") == "confirmed", c("verdict") == "hold"
    waits, unsure = hold & (c("hold_reason") == "premise_unknown"), hold & (c("hold_reason") == "low_conf")
    bad, subst, asked = c("n_violations") > 0, c("subst_cap").isNotNull(), c("fact_kind").isNotNull()
    facts = F.size("answered") > 0
    return {
        "reason_iff_hold": hold == c("hold_reason").isNotNull(),
        "clean_is_r0": _implies(confirmed & ~bad & c("risk").isNotNull(), c("risk") == R0),
        "violation_above_r0": _implies(confirmed & bad & c("risk").isNotNull(), c("risk") > R0),
        "violation_has_cause": _implies(confirmed & bad, c("infeasibility").isNotNull()),
        "violation_has_evidence": _implies(confirmed & bad, c("n_evidence") > 0),
        "not_claim_is_clean": _implies(c("not_claim"), confirmed & ~bad & (c("n_spans") == 0) & ~subst & (F.coalesce("risk", F.lit(R0)) == R0)),
        "encoder_on_hold": _implies(c("encoder").isNotNull(), hold & ~c("not_claim")),
        "encoder_has_basis": _implies(c("encoder").isNotNull(), c("encoder_basis").isNotNull()),
        "subst_for_b": _implies(subst, c("infeasibility") == "B"),
        "subst_verdict": _implies(subst, confirmed | hold),
        "subst_hold_reason": _implies(subst & hold, waits | unsure),
        "subst_has_risk": _implies(subst, c("risk").isNotNull()),
        "subst_not_above": _implies(subst & c("risk").isNotNull(), c("subst_cap") <= c("risk")),
        "answers_distinct": F.size("answered") == F.size(F.array_distinct("answered")),
        "answers_place": _implies(facts, confirmed | (waits & (asked | subst)) | unsure),
        "asked_once": _implies(asked, ~F.array_contains("answered", c("fact_kind"))),
        "subst_answer_place": _implies(c("subst_answered"), ~asked & (confirmed | unsure)),
        "question_for_claims": _implies(asked, ~c("not_claim")),
        "question_on_open_hold": _implies(asked, waits | unsure),
        "question_has_risk": _implies(asked, c("risk").isNotNull()),
        "question_not_above": _implies(asked & c("risk").isNotNull(), c("fact_cap") <= c("risk")),
    }


#: Dispositions by rank: a phrase takes the first that any clause with it has.
PLACES = ("violation", "lawful", "dropped")


def place_phrases(clauses: DataFrame, phrases: DataFrame, doc: str, text: str, phrase: str) -> DataFrame:
    """doc, phrase, place for each distinct phrase of a document.

    ``clauses`` has ``disposition`` from ``carry_forward`` with the default "document", which stands for the document's own: the first of PLACES that
    a clause has, else "violation". White space does not count; a phrase in no clause goes by the document. A document's phrases are looked for in its
    clauses together, by an automaton, in blocks of a stated size (``automaton.phrases_in``).
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PLACES)), F.col("disposition")), F.lit(0))
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    c = written(clauses.select(doc, squeeze(F.col(text)).alias("_t"), F.when(rank > 0, rank).alias("_r")), "clauses")  # read three times
    whole = c.groupBy(doc).agg(F.coalesce(F.min("_r"), F.lit(1)).alias("_whole"))
    p = phrases.select(doc, phrase, squeeze(F.col(phrase)).alias("_p")).distinct()
    p = written(p, "phrases")
    # the best rank of the clauses with one text, and whether one of them goes by the document
    marks = c.where(F.col("_t").isNotNull()).groupBy(doc, F.col("_t").alias("text")).agg(F.struct(F.min("_r").cast("int").alias("_r"), F.bool_or(F.col("_r").isNull()).alias("_own")).alias("mark"))
    marks = marks.select(doc, "text", (F.coalesce("mark._r", F.lit(0)) * 2 + F.col("mark._own").cast("int")).alias("mark"))
    met = phrases_in(p.where("_p <> ''").select(doc, F.col("_p").alias("phrase")).distinct(), marks, doc)
    met = met.select(F.col("g").alias(doc), F.col("phrase").alias("_p"), F.when(F.col("mark") > 1, F.floor(F.col("mark") / 2)).alias("_r"), (F.col("mark") % 2 == 1).alias("_own"))
    hits = p.join(met, [doc, "_p"])
    best = hits.groupBy(doc, phrase).agg(F.min("_r").alias("_best"), F.bool_or("_own").alias("_open"))
    j = p.select(doc, phrase).join(best, [doc, phrase], "left").join(whole, doc, "left")
    own = F.coalesce("_whole", F.lit(1))
    place = F.when(F.col("_best").isNull() | F.col("_open"), F.least(F.coalesce("_best", own), own)).otherwise(F.col("_best"))
    return j.select(doc, phrase, F.element_at(F.array(*map(F.lit, PLACES)), place.cast("int")).alias("place"))
