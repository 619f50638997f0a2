"""Rules that a response must meet as a whole: its outcome against its sentences, its branches, its category.

A breach is a row. Sentences and branches are folded to one row a response by grouped aggregates, so a response of any length is never
gathered; branches meet their recorded sentences by an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.judge import R0, _implies, breaches


def _any(when: Column) -> Column:
    """Whether it is known to hold for a row of the group."""
    return F.bool_or(F.coalesce(when, F.lit(False)))


def sentence_facts(sentences: DataFrame, doc: str) -> DataFrame:
    """One row a response of what the rules ask about its sentences.

    Columns: ``doc``, verdict, hold_reason, n_violations, infeasibility, risk, n_spans, and booleans: subst (a branch for substantiation),
    asked (an open question of fact), denied (the user answered that the fact is false).
    """
    c = F.col
    settled = F.coalesce(c("verdict") == "confirmed", F.lit(False))
    own = F.coalesce(c("subst"), F.lit(False)) | F.coalesce(c("asked"), F.lit(False))
    conditional = (c("verdict") == "hold") & (c("hold_reason") == "premise_unknown") & own & c("risk").isNotNull()
    to_prove = (c("infeasibility") == "B") & (c("n_violations") > 0)
    helpless = ~F.coalesce(c("subst"), F.lit(False)) & ~F.coalesce(c("denied"), F.lit(False)) | (F.coalesce("n_spans", F.lit(0)) == 0)
    return sentences.groupBy(doc).agg(
        F.count("*").alias("n_sentences"),
        _any(~settled | c("risk").isNull() | (c("risk") > R0)).alias("unclean"),
        _any(~settled & ~F.coalesce(conditional, F.lit(False))).alias("unsettled"),
        _any(c("infeasibility").isin("A", "C")).alias("has_ac"),
        _any(c("infeasibility") == "A").alias("has_a"),
        _any(to_prove).alias("has_b"),
        _any(to_prove & helpless).alias("thin_b"),
        _any(c("hold_reason").isin("cat_unknown", "premise_unknown") & ~own).alias("needs_branch"),
        _any(c("hold_reason") == "law_uncovered").alias("law_hold"),
    )


def branch_facts(branches: DataFrame, sentences: DataFrame, doc: str, sid: str) -> DataFrame:
    """One row a response of what the rules ask about its branches (``doc``, branch, premise, verified, ``sid``, risk), a row a sentence of each."""
    recorded = sentences.select(doc, sid, F.col("risk").alias("_recorded"), F.lit(True).alias("_known"))
    met = branches.join(recorded, [doc, sid], "left")
    one = met.groupBy(doc, "branch").agg(
        F.max("premise").alias("premise"),
        _any(F.col("verified")).alias("verified"),
        _any(F.col("_known").isNull()).alias("stray"),
        _any(F.col("risk").isNotNull() & (F.col("_recorded").isNull() | (F.col("_recorded") < F.col("risk")))).alias("worse"),
    )
    by_premise = one.groupBy(doc, "premise").agg(F.count("*").alias("same"), F.count_if("verified").alias("verified"), F.bool_or("stray").alias("stray"), F.bool_or("worse").alias("worse"))
    return by_premise.groupBy(doc).agg(F.max("same").alias("same_premise"), F.sum("verified").alias("n_verified"), F.bool_or("stray").alias("stray"), F.bool_or("worse").alias("worse"))


def response_rules(uncovered: Sequence[str]) -> dict[str, Column]:
    """Rules over one row a response, with the facts of its sentences and branches. ``uncovered``: categories whose main law is not reviewed."""
    c = F.col
    outcome = lambda name: F.coalesce(c("outcome") == name, F.lit(False))
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    certified, offered = c("certificate").isNotNull(), F.coalesce("n_candidates", F.lit(0)) > 0
    open_law = F.coalesce(c("category").isin(*uncovered), F.lit(False))
    guided = outcome("guidance")
    return {
        "certificate_given": _implies(outcome("certificate"), certified),
        "certificate_not_for_b": _implies(outcome("certificate") & certified, c("certificate") != "B"),
        "certificate_alone": _implies(outcome("certificate"), ~offered),
        "certificate_only_then": _implies(certified, outcome("certificate")),
        "candidates_on_pass": _implies(offered, outcome("passed")),
        "candidates_not_for_a": _implies(offered, ~flag("has_a")),
        "pass_is_clean": _implies(outcome("passed"), ~flag("unclean")),
        "one_round": c("attempt") == 0,
        "guidance_is_settled": _implies(guided, (c("n_sentences") > 0) & ~flag("unsettled")),
        "guidance_without_ac": _implies(guided, ~flag("has_ac")),
        "guidance_has_b": _implies(guided, flag("has_b")),
        "guidance_says_how": _implies(guided, ~flag("thin_b")),
        "one_verified": F.coalesce("n_verified", F.lit(0)) <= 1,
        "record_not_below": _implies(F.coalesce("n_verified", F.lit(0)) == 0, ~flag("worse")),
        "hold_has_branches": _implies(flag("needs_branch"), c("same_premise").isNotNull()),
        "premises_distinct": F.coalesce("same_premise", F.lit(1)) == 1,
        "branches_of_response": ~flag("stray"),
        "notice_iff_uncovered": open_law == (F.coalesce("n_not_reviewed", F.lit(0)) > 0),
        "uncovered_never_passes": _implies(open_law, ~outcome("passed")),
        "law_hold_where_uncovered": _implies(flag("law_hold"), open_law),
        "category_has_source": c("category").isNull() == c("category_source").isNull(),
    }


def response_contract(responses: DataFrame, sentences: DataFrame, branches: DataFrame, doc: str, sid: str, uncovered: Sequence[str]) -> DataFrame:
    """(``doc``, rule_id) of every rule that a response breaks.

    ``responses``: ``doc``, outcome, category, category_source, n_not_reviewed, certificate (its reason), n_candidates, attempt; one row a
    ``doc``, which is not null. (``doc``, ``sid``) is unique in ``sentences``. Sentences and branches of no response are ignored; a
    response without any has none; unknown booleans and counts stand for no and zero, an unknown attempt breaks its rule.
    """
    own = responses.select(doc, "outcome", "category", "category_source", "n_not_reviewed", "certificate", "n_candidates", "attempt")
    facts = own.join(sentence_facts(sentences, doc), doc, "left").join(branch_facts(branches, sentences, doc, sid), doc, "left")
    return breaches(facts, [doc], response_rules(uncovered))
