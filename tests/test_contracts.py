"""The contract of whole responses against a plain version, on odd rows, and on a table where every rule breaks."""

import random
from collections import Counter, defaultdict

from sparkloom import registry
from sparkloom.operators import contracts as C

RESPONSES = "doc long, outcome string, category string, category_source string, n_not_reviewed int, certificate string, n_candidates int, attempt int"
SENTENCES = "doc long, sid long, verdict string, hold_reason string, n_violations int, infeasibility string, risk int, n_spans int, subst boolean, asked boolean, denied boolean"
BRANCHES = "doc long, branch int, premise string, verified boolean, sid long, risk int"


def broken(r, sentences, branches):
    """Names of the rules that a response breaks, told one by one."""
    out = set()

    def claim(name, holds):
        if not holds:
            out.add(name)

    candidates, sids = (r["n_candidates"] or 0) > 0, {s["sid"]: s for s in sentences}
    if r["outcome"] == "certificate":
        claim("certificate_given", r["certificate"] is not None)
        claim("certificate_not_for_b", r["certificate"] != "B")
        claim("certificate_alone", not candidates)
    elif r["certificate"] is not None:
        out.add("certificate_only_then")
    if candidates:
        claim("candidates_on_pass", r["outcome"] == "passed")
        claim("candidates_not_for_a", all(s["infeasibility"] != "A" for s in sentences))
    if r["outcome"] == "passed":
        claim("pass_is_clean", all(s["verdict"] == "confirmed" and s["risk"] == 0 for s in sentences))
    claim("one_round", r["attempt"] == 0)
    if r["outcome"] == "guidance":
        waits = lambda s: s["verdict"] == "hold" and s["hold_reason"] == "premise_unknown" and (s["subst"] or s["asked"]) and s["risk"] is not None
        claim("guidance_is_settled", sentences and all(s["verdict"] == "confirmed" or waits(s) for s in sentences))
        claim("guidance_without_ac", not any(s["infeasibility"] in ("A", "C") for s in sentences))
        proof = [s for s in sentences if s["infeasibility"] == "B" and (s["n_violations"] or 0) > 0]
        claim("guidance_has_b", proof)
        claim("guidance_says_how", all((s["subst"] or s["denied"]) and s["n_spans"] for s in proof))
    groups = defaultdict(list)
    for b in branches:
        groups[b["branch"]].append(b)
    verified = [k for k, rows in groups.items() if any(b["verified"] for b in rows)]
    claim("one_verified", len(verified) < 2)
    if not verified:
        for b in branches:
            s = sids.get(b["sid"])
            claim("record_not_below", b["risk"] is None or s and s["risk"] is not None and s["risk"] >= b["risk"])
    if any(s["hold_reason"] in ("cat_unknown", "premise_unknown") and not s["subst"] and not s["asked"] for s in sentences):
        claim("hold_has_branches", groups)
    claim("premises_distinct", len({rows[0]["premise"] for rows in groups.values()}) == len(groups))
    claim("branches_of_response", all(b["sid"] in sids for b in branches))
    uncovered = r["category"] in ("law", "goods")
    claim("notice_iff_uncovered", uncovered == ((r["n_not_reviewed"] or 0) > 0))
    claim("uncovered_never_passes", not uncovered or r["outcome"] != "passed")
    claim("law_hold_where_uncovered", uncovered or all(s["hold_reason"] != "law_uncovered" for s in sentences))
    claim("category_has_source", (r["category"] is None) == (r["category_source"] is None))
    return out


def test_response_contract_equals_plain_rules(spark):
    rng = random.Random(4)
    pick = lambda *xs: rng.choice(xs)
    responses, sentences, branches = [], [], []
    for doc in range(300):
        responses.append((doc, pick("certificate", "guidance", "passed", "hold", None), pick("law", "goods", "food", None), pick("given", "given", None), pick(0, 0, 1, None), pick(None, None, "A", "B"), pick(0, 0, 2, None), pick(0, 0, 0, 1, None)))
        n = pick(0, 1, 1, 2, 5)
        for k in range(n):
            sentences.append((doc, k, pick("confirmed", "confirmed", "hold", None), pick(None, None, "premise_unknown", "cat_unknown", "law_uncovered", "low_conf"), pick(0, 1, None), pick(None, "B", "B", "A", "C"), pick(0, 0, 1, 3, None), pick(0, 1, 1, None), pick(True, False, None), pick(True, False, None), pick(True, False, None)))
        for b in range(pick(0, 0, 1, 2, 3)):
            premise, verified = pick("p", "q", "r", None), pick(False, False, True, None)
            branches += [(doc, b, premise, verified, pick(*range(max(1, n)), k), pick(0, 0, 1, 3, None)) for k in range(pick(1, 2, 7))]
    branches.append((999, 0, "p", True, 0, 1))  # of no response
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((responses, RESPONSES), (sentences, SENTENCES), (branches, BRANCHES))]
    got = Counter(map(tuple, C.response_contract(*frames, "doc", "sid", ["law", "goods"]).collect()))
    named = [[dict(zip([c.split()[0] for c in schema.split(", ")], row, strict=True)) for row in rows] for rows, schema in ((responses, RESPONSES), (sentences, SENTENCES), (branches, BRANCHES))]
    of = lambda rows, doc: [x for x in rows if x["doc"] == doc]
    want = Counter((r["doc"], name) for r in named[0] for name in broken(r, of(named[1], r["doc"]), of(named[2], r["doc"])))
    assert got == want and {name for _, name in want} == set(C.response_rules(["law"]))
    empty = [f.limit(0) for f in frames]
    assert C.response_contract(*empty, "doc", "sid", ["law"]).count() == 0
    alone = {r.doc for r in C.response_contract(frames[0], empty[1], empty[2], "doc", "sid", ["law", "goods"]).where("rule_id = 'guidance_is_settled'").collect()}
    assert alone == {r[0] for r in responses if r[1] == "guidance"}


def test_every_response_rule_breaks_and_holds(spark, sf):
    counts = {r.rule_id: r["count"] for r in registry.queries()["response_contract"](spark, "/root/testdata/sf0.01").groupBy("rule_id").count().collect()}
    total = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id").distinct().count()
    assert set(counts) == set(C.response_rules(["other_law"])) and max(counts.values()) < total
