"""Queries of judgment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import contracts as C
from sparkloom.operators import judge as J
from sparkloom.operators.matching import contained
from sparkloom.registry import query
from sparkloom.session import table

#: Sentences: turns of conversations with counts that stand for hits, and facts by parity of their keys.
SENT = """s AS (SELECT conv_id, turn, role, conv_id * 1000 + turn AS sid, length(text) AS n, turn % 7 <> 6 AS scanned, CAST(contains(text, 'ther') AS INT) + CAST(contains(text, 'tion') AS INT) AS strong,
    CAST(contains(text, 'ing') AS INT) AS demoted, regexp_matches(text, '[!?]') OR length(text) < 120 AS caution, conv_id % 5 <> 0 AS typed, turn % 3 <> 2 AS reasoned, conv_id % 3 <> 0 AS based FROM conversations)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    t, c, n = F.col("text"), F.col("conv_id"), F.col("turn")
    has = lambda w: t.contains(w).cast("int")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", "role", (c * 1000 + n).alias("sid"), F.length(t).alias("n"), (n % 7 != 6).alias("scanned"), (has("ther") + has("tion")).alias("strong"), has("ing").alias("demoted"),
        (t.rlike("[!?]") | (F.length(t) < 120)).alias("caution"), (c % 5 != 0).alias("typed"), (n % 3 != 2).alias("reasoned"), (c % 3 != 0).alias("based"),
    )


CASCADE = """CASE WHEN NOT scanned THEN 'unjudged' WHEN strong = 0 AND demoted = 0 AND caution THEN 'confirmed' WHEN strong > 0 AND NOT typed THEN 'hold' WHEN strong > 0 AND NOT reasoned THEN 'hold' WHEN strong > 0 AND NOT based THEN 'no_basis' WHEN strong > 0 THEN 'confirmed' WHEN sid % 13 = 0 THEN 'no_basis' ELSE 'hold' END"""
WHY = """CASE WHEN NOT scanned THEN NULL WHEN strong = 0 AND demoted = 0 AND caution THEN 'not_claim' WHEN strong > 0 AND (NOT typed OR NOT reasoned) THEN 'low_conf' WHEN strong > 0 AND NOT based THEN NULL WHEN strong > 0 THEN 'hit' WHEN sid % 13 = 0 THEN NULL ELSE 'low_conf' END"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    v = J.verdict(F.col("scanned"), F.col("strong"), F.col("demoted"), F.col("caution"), F.col("typed"), F.col("reasoned"), F.col("based"), F.col("sid") % 13 == 0)
    return _sentences(spark, d).withColumn("v", v).select("*", "v.verdict", "v.reason").drop("v")


@query(f"WITH {SENT} SELECT sid, {CASCADE} AS verdict, {WHY} AS reason FROM s")
def verdict_cascade(spark, d):
    return _judged(spark, d).select("sid", "verdict", "reason")


RULES = [("L0", "T1", "a", "all", 2, True), ("L0", "T1", "b", "partial", 3, True), ("L0", "T2", None, "all", 1, False), ("L1", "T1", "c", "partial", 2, True), ("L1", "T2", None, "all", 3, False), ("L2", "T2", None, "all", 2, False)]
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in RULES) + ") AS v(law, type, code, cover, risk, family))"
HITS = "h AS (SELECT p_partkey, 'L' || (p_partkey % 5) AS law, 'T' || (p_size % 3 + 1) AS type, chr(97 + CAST(p_size % 4 AS INT)) AS code, p_size % 3 = 0 AS sub_items FROM part)"
FLOORS = f"""{RULE_SQL}, {HITS}, m AS (SELECT law, type, max(risk) AS top, bool_or(family) AS family FROM rules GROUP BY 1, 2), k AS (SELECT DISTINCT law FROM rules),
    c AS (SELECT law, type, code, max(risk) FILTER (cover = 'all') AS f, max(risk) FILTER (cover = 'partial') AS p FROM rules WHERE code IS NOT NULL GROUP BY 1, 2, 3),
    j AS (SELECT h.*, m.top, coalesce(m.family, h.sub_items) AS fam, k.law IS NOT NULL AS known, c.f, c.p FROM h LEFT JOIN m ON m.law = h.law AND m.type = h.type LEFT JOIN k ON k.law = h.law LEFT JOIN c ON c.law = h.law AND c.type = h.type AND c.code = h.code),
    floors AS (SELECT p_partkey, law, type, code, CASE WHEN fam THEN CASE WHEN known THEN coalesce(f, 1) END ELSE top END AS floor,
    CASE WHEN fam AND known THEN CASE WHEN p IS NOT NULL THEN CASE WHEN p > coalesce(f, 1) THEN p END WHEN f IS NULL AND top > 1 THEN top END END AS ceiling FROM j)"""


def _floors(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    hits = table(spark, d, "part").select("p_partkey", F.concat(F.lit("L"), (F.col("p_partkey") % 5).cast("string")).alias("law"), F.concat(F.lit("T"), (s % 3 + 1).cast("string")).alias("type"), F.char((s % 4 + 97).cast("int")).alias("code"), (s % 3 == 0).alias("sub_items"))
    return J.floors(hits, spark.createDataFrame(RULES, "law string, type string, code string, cover string, risk int, family boolean"), ["law", "type"], "code")


@query(f"WITH {FLOORS} SELECT p_partkey, law, type, code, floor, ceiling FROM floors")
def sanction_floor(spark, d):
    return _floors(spark, d).select("p_partkey", "law", "type", "code", "floor", "ceiling")


@query(f"WITH {FLOORS}, g AS (SELECT p_partkey % 200 AS sentence, bool_or(floor IS NULL) AS u, max(floor) AS f, max(ceiling) AS c FROM floors GROUP BY 1) SELECT sentence, CASE WHEN NOT u THEN f END AS floor, CASE WHEN NOT u AND c > f THEN c END AS ceiling FROM g")
def floor_combine(spark, d):
    return J.combine_floors(_floors(spark, d).withColumn("sentence", F.col("p_partkey") % 200), ["sentence"])


@query(f"WITH {FLOORS}, e AS (SELECT p_partkey, floor, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 4 END AS encoder FROM floors) SELECT p_partkey, floor, encoder, greatest(floor, least(encoder, CASE WHEN encoder IS NULL THEN NULL ELSE 1 END)) AS final FROM e")
def ratchet(spark, d):
    e = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 4)
    return _floors(spark, d).select("p_partkey", "floor", e.alias("encoder"), J.ratchet(F.col("floor"), e).alias("final"))


PREM = "p AS (SELECT * FROM (VALUES ('user', 'p1', 0), ('user', 'p2', 1), ('assistant', 'p3', 1), ('assistant', 'p4', 1)) AS v(of_category, premise, shift))"
BRANCH = f"""{SENT}, {PREM}, b AS (SELECT sid, premise, CASE WHEN strong + shift > 0 THEN 'confirmed' ELSE 'hold' END AS verdict, list_sort(list_filter([CASE WHEN strong > 0 THEN 'x' END, CASE WHEN shift = 1 THEN 'y' END], lambda v: v IS NOT NULL)) AS violations, least(3, strong + shift) AS risk
    FROM (SELECT *, CASE WHEN conv_id % 6 = 0 THEN NULL ELSE role END AS category FROM s) s JOIN p ON category IS NULL OR category = of_category)"""


def _branches(spark: SparkSession, d: str) -> DataFrame:
    prem = spark.createDataFrame([("user", "p1", 0), ("user", "p2", 1), ("assistant", "p3", 1), ("assistant", "p4", 1)], "of_category string, premise string, shift int")
    s = _sentences(spark, d).withColumn("category", F.when(F.col("conv_id") % 6 != 0, F.col("role")))
    b = J.premise_branches(s, prem, "category")
    viol = F.array_sort(F.array_compact(F.array(F.when(F.col("strong") > 0, "x"), F.when(F.col("shift") == 1, "y"))))
    return b.select("sid", "premise", F.when(F.col("strong") + F.col("shift") > 0, "confirmed").otherwise("hold").alias("verdict"), viol.alias("violations"), F.least(F.lit(3), F.col("strong") + F.col("shift")).alias("risk"))


@query(f"WITH {BRANCH} SELECT sid, premise, verdict, array_to_string(violations, ',') AS violations, risk FROM b")
def premise_fanout(spark, d):
    return _branches(spark, d).withColumn("violations", F.array_join("violations", ","))


RECORD = f"""{BRANCH}, h AS (SELECT *, verdict = 'confirmed' AND len(violations) > 0 AS hit, array_to_string(violations, ',') AS v FROM b),
    g AS (SELECT sid, count(*) AS n, count(*) FILTER (hit) AS hits, count(DISTINCT v) FILTER (hit) AS kinds, max(risk) FILTER (hit) AS risk, arg_max(v, (risk, v)) FILTER (hit) AS worst FROM h GROUP BY sid),
    rec AS (SELECT sid, CASE WHEN hits = 0 THEN 'unchanged' WHEN hits = n AND kinds = 1 THEN 'confirmed' ELSE 'hold' END AS record, risk, worst AS violations FROM g)"""


@query(f"WITH {RECORD} SELECT * FROM rec")
def conservative_record(spark, d):
    return J.recorded(_branches(spark, d), "sid")


@query(f"WITH {BRANCH} SELECT sid, verdict || '|' || array_to_string(violations, ',') || '|' || risk AS result, string_agg(premise, ',' ORDER BY premise) AS premises FROM b GROUP BY 1, 2")
def branch_folding(spark, d):
    return J.folded(_branches(spark, d), "sid").withColumn("premises", F.array_join("premises", ","))


ROUTE = f"{SENT}, v AS (SELECT *, {CASCADE} AS verdict, {WHY} AS reason FROM s), x AS (SELECT conv_id, verdict, strong > 0 AS viol, CASE WHEN sid % 11 = 0 THEN NULL ELSE least(strong, 3) END AS risk, CASE sid % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS rc, coalesce(reason = 'not_claim', FALSE) AS not_claim, CASE WHEN conv_id % 6 = 0 THEN NULL ELSE role END AS category FROM v)"


def _routable(spark: SparkSession, d: str) -> DataFrame:
    viol = F.when(F.col("strong") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return _judged(spark, d).select(
        "conv_id", "sid", "verdict", viol.alias("violations"), F.when(F.col("sid") % 11 != 0, F.least("strong", F.lit(3))).alias("risk"), F.when(F.col("sid") % 3 == 0, "A").when(F.col("sid") % 3 == 1, "B").alias("reason_class"),
        F.coalesce(F.col("reason") == "not_claim", F.lit(False)).alias("not_claim"), F.when(F.col("conv_id") % 6 != 0, F.col("role")).alias("category"),
    )


@query(f"WITH {ROUTE} SELECT conv_id, CASE WHEN bool_or(verdict <> 'confirmed') OR bool_or(viol AND risk IS NULL) THEN 'hold' WHEN bool_or(viol AND rc IN ('A', 'C')) THEN 'certificate' WHEN bool_or(viol AND rc = 'B') THEN 'guidance' WHEN bool_or(not_claim AND category IS NULL) THEN 'hold' ELSE 'passed' END AS outcome FROM x GROUP BY conv_id")
def outcome_route(spark, d):
    return J.route(_routable(spark, d), "conv_id")


@query("WITH o AS (SELECT conv_id * 1000 + turn AS sid, role, turn FROM conversations WHERE turn % 3 <> 2), n AS (SELECT conv_id * 1000 + turn AS sid, upper(role) AS role, turn FROM conversations WHERE turn % 2 = 0) SELECT coalesce(o.sid, n.sid) AS sid, CASE WHEN n.sid IS NOT NULL THEN n.role ELSE o.role END AS role, coalesce(o.turn, n.turn + (SELECT max(turn) + 1 FROM o)) AS turn FROM o FULL OUTER JOIN n ON o.sid = n.sid")
def upsert_reducer(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sid"), "role", "turn")
    return J.upsert_sentences(c.where("turn % 3 <> 2"), c.where("turn % 2 = 0").withColumn("role", F.upper("role")), "sid", ["role"], "turn")


@query(f"WITH {SENT}, a AS (SELECT sid, CASE sid % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'na' END AS answer FROM s WHERE strong > 0 AND sid % 4 < 3) SELECT s.sid, CASE WHEN strong = 0 THEN 'none' WHEN answer = 'yes' THEN 'cleared' WHEN answer = 'no' THEN 'confirmed' WHEN answer = 'na' THEN 'open' ELSE 'asked' END AS state FROM s LEFT JOIN a USING (sid)")
def answers_applied(spark, d):
    """Answers to fact questions re-evaluate their sentence; a question without an answer stays asked."""
    s = _sentences(spark, d).select("sid", "strong")
    k = F.col("sid") % 4
    a = s.where((F.col("strong") > 0) & (k < 3)).select("sid", F.when(k == 0, "yes").when(k == 1, "no").otherwise("na").alias("answer"))
    ans = F.col("answer")
    state = F.when(F.col("strong") == 0, "none").when(ans == "yes", "cleared").when(ans == "no", "confirmed").when(ans == "na", "open").otherwise("asked")
    return s.join(a, "sid", "left").select("sid", state.alias("state"))


@query(f"WITH {SENT} SELECT conv_id, count(*) AS sentences, concat_ws(',', CASE WHEN bool_or(strong > 1) THEN 'several_hits' END, CASE WHEN count(*) FILTER (strong > 0) * 2 > count(*) THEN 'mostly_hits' END, CASE WHEN count(DISTINCT role) = 1 THEN 'one_voice' END) AS warnings FROM s GROUP BY conv_id")
def doc_rules(spark, d):
    w = F.array_compact(F.array(F.when(F.bool_or(F.col("strong") > 1), "several_hits"), F.when(F.count_if(F.col("strong") > 0) * 2 > F.count("*"), "mostly_hits"), F.when(F.countDistinct("role") == 1, "one_voice")))
    return _sentences(spark, d).groupBy("conv_id").agg(F.count("*").alias("sentences"), F.array_join(w, ",").alias("warnings"))


@query(f"WITH {SENT}, c AS (SELECT sid, conv_id FROM s WHERE strong > 0 AND typed), r AS (SELECT c.sid, d.doc_id, row_number() OVER (PARTITION BY c.sid ORDER BY d.n_chars, d.doc_id) AS r FROM c JOIN documents d ON d.source = 'src' || (c.conv_id % 20) AND d.lang IN ('en', 'de')) SELECT sid, doc_id, r FROM r WHERE r <= 2")
def reference_pick(spark, d):
    """Post-verdict references, only of the documents allowed for the type; verdict fields stay as they are."""
    from sparkloom.operators.retrieval import top_per

    c = _sentences(spark, d).where("strong > 0 AND typed").select("sid", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("source"))
    ref = table(spark, d, "documents").where(F.col("lang").isin("en", "de")).select("source", "doc_id", "n_chars")
    two = top_per(ref, ["source"], [F.asc("n_chars"), F.asc("doc_id")], 2, "r")  # first two a source, before the join fans out
    return c.join(two, "source").select("sid", "doc_id", "r")


@query("SELECT vec_id, array_to_string(list_filter([CASE WHEN embedding[1]::DOUBLE >= 0.1 THEN 'a' END, CASE WHEN embedding[2]::DOUBLE >= 0.05 THEN 'b' END, CASE WHEN embedding[3]::DOUBLE >= 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS labels FROM embeddings")
def label_threshold(spark, d):
    probs = F.transform(F.slice("embedding", 1, 3), lambda p: p.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(J.over_threshold(probs, [0.1, 0.05, 0.0], ["a", "b", "c"]), ",").alias("labels"))


@query(f"WITH {ROUTE} SELECT sid, rule_id FROM (SELECT sid, unnest(['known_risk', 'unjudged_empty', 'hold_reason', 'risk_range']) AS rule_id, unnest([strong = 0 OR sid % 11 <> 0, verdict <> 'unjudged' OR strong = 0, verdict <> 'hold' OR reason IS NOT NULL, strong <= 3]) AS ok FROM v) WHERE NOT ok")
def contract_violations(spark, d):
    v = F.col("verdict")
    rules = {"known_risk": (F.col("strong") == 0) | (F.col("sid") % 11 != 0), "unjudged_empty": (v != "unjudged") | (F.col("strong") == 0), "hold_reason": (v != "hold") | F.col("reason").isNotNull(), "risk_range": F.col("strong") <= 3}
    return J.breaches(_judged(spark, d), ["sid"], rules)


@query(f"WITH {ROUTE} SELECT sid, CASE verdict WHEN 'confirmed' THEN 0 WHEN 'hold' THEN 1 WHEN 'no_basis' THEN 2 ELSE 3 END AS verdict_no, CASE WHEN conv_id % 6 <> 0 THEN role END AS category, CASE WHEN conv_id % 6 <> 0 THEN 'given' END AS category_source FROM v WHERE reason IS DISTINCT FROM 'not_claim'")
def judgment_rows(spark, d):
    """Stored rows: no not-claims, enums as integers, category and its source both or none."""
    v = F.col("verdict")
    no = F.when(v == "confirmed", 0).when(v == "hold", 1).when(v == "no_basis", 2).otherwise(3)
    given = F.col("conv_id") % 6 != 0
    return _judged(spark, d).where(~F.col("reason").eqNullSafe("not_claim")).select("sid", no.alias("verdict_no"), F.when(given, F.col("role")).alias("category"), F.when(given, "given").alias("category_source"))


@query(f"WITH {SENT} SELECT sid, coalesce(last_value(CASE WHEN strong > 1 THEN 'violation' WHEN caution THEN 'lawful' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'document') AS disposition FROM s")
def clause_carry_forward(spark, d):
    head = F.when(F.col("strong") > 1, "violation").when(F.col("caution"), "lawful")
    return J.carry_forward(_sentences(spark, d), "conv_id", "turn", head, "document").select("sid", "disposition")


@query("WITH s AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || '|' || quality) AS fp, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE CAST(quality + 1 AS VARCHAR) END AS cell, CASE WHEN doc_id % 17 = 0 THEN 'changed' ELSE sha256(CAST(doc_id AS VARCHAR) || '|' || quality) END AS seen FROM labels) SELECT doc_id, CASE WHEN fp <> seen THEN 'text_changed' WHEN cell NOT IN ('1', '2') THEN 'unreadable' ELSE 'ok' END AS state, CASE WHEN fp = seen AND cell IN ('1', '2') THEN ['low', 'good'][CAST(cell AS INT)] END AS label FROM s")
def sheet_import(spark, d):
    """Row fingerprints guard the text, number codes become labels, unreadable cells are named."""
    fp = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.col("quality").cast("string")), 256)
    s = table(spark, d, "labels").select("doc_id", fp.alias("fp"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise((F.col("quality") + 1).cast("string")).alias("cell"), F.when(F.col("doc_id") % 17 == 0, "changed").otherwise(fp).alias("seen"))
    same, read = F.col("fp") == F.col("seen"), F.col("cell").isin("1", "2")
    return s.select("doc_id", F.when(~same, "text_changed").when(~read, "unreadable").otherwise("ok").alias("state"), F.when(same & read, F.when(F.col("cell") == "1", "low").otherwise("good")).alias("label"))


@query("WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS q FROM benchmark), s AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents) SELECT item_id, count(s.doc_id) > 0 AS verified, count(s.doc_id) AS sources FROM b LEFT JOIN s ON contains(s.t, b.q) GROUP BY item_id")
def rule_lint(spark, d):
    """A quote must occur in a source text once white space is gone."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", "").alias("term_norm"))
    hits = contained(table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", "").alias("text_norm")), b).groupBy("item_id").agg(F.count("*").alias("n"))
    return b.join(hits, "item_id", "left").select("item_id", F.col("n").isNotNull().alias("verified"), F.coalesce("n", F.lit(0)).alias("sources"))


@query("WITH t AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS head, strpos(html, '<h1') AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) SELECT page_id, head <> '' AND contains(title, head) AS contained, coalesce(pos > lag(pos) OVER (PARTITION BY page_id % 25 ORDER BY page_id), TRUE) AS in_order FROM t")
def toc_check(spark, d):
    """Declared headings lie in their page, and places follow the declared order."""
    from pyspark.sql import Window

    t = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("head"), F.instr("html", "<h1").alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    w = Window.partitionBy(F.col("page_id") % 25).orderBy("page_id")
    return t.select("page_id", ((F.col("head") != "") & F.col("title").contains(F.col("head"))).alias("contained"), F.coalesce(F.col("pos") > F.lag("pos").over(w), F.lit(True)).alias("in_order"))


#: Columns of a judged sentence, derived from its number so that every rule of the contract has rows that break it.
CONTRACT = {
    "hold_reason": "CASE WHEN verdict = 'hold' THEN CASE WHEN sid % 3 = 0 THEN 'premise_unknown' WHEN sid % 31 = 0 THEN NULL ELSE 'low_conf' END WHEN sid % 29 = 0 THEN 'other' END",
    "n_violations": "CASE WHEN strong > 0 THEN strong WHEN sid % 37 = 0 THEN 1 ELSE 0 END",
    "infeasibility": "CASE sid % 4 WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'C' END",
    "n_evidence": "sid % 5",
    "risk": "CASE WHEN sid % 6 < 5 THEN sid % 4 END",
    "encoder": "CASE WHEN sid % 7 = 0 THEN 1 END",
    "encoder_basis": "CASE WHEN sid % 2 = 0 THEN 'item' END",
    "not_claim": "coalesce(reason = 'not_claim', FALSE)",
    "n_spans": "sid % 2",
    "subst_cap": "CASE WHEN sid % 8 IN (1, 2) THEN sid % 7 % 4 END",
    "fact_kind": "CASE sid % 9 WHEN 2 THEN 'f1' WHEN 3 THEN 'f2' END",
    "fact_cap": "CASE WHEN sid % 9 IN (2, 3) THEN sid % 3 END",
    "answers": "CASE sid % 10 WHEN 0 THEN 'f1' WHEN 1 THEN 'f1,f2' WHEN 2 THEN 'f2,f2' ELSE '' END",
    "subst_answered": "sid % 11 = 3",
}
OPEN = "verdict = 'hold' AND hold_reason IS NOT DISTINCT FROM 'premise_unknown'"
SHAKY = "verdict = 'hold' AND hold_reason IS NOT DISTINCT FROM 'low_conf'"
#: Breaches, each as the condition under which its rule is broken.
BROKEN = {
    "reason_iff_hold": "(verdict = 'hold') <> (hold_reason IS NOT NULL)",
    "clean_is_r0": "verdict = 'confirmed' AND n_violations = 0 AND risk <> 0",
    "violation_above_r0": "verdict = 'confirmed' AND n_violations > 0 AND risk = 0",
    "violation_has_cause": "verdict = 'confirmed' AND n_violations > 0 AND infeasibility IS NULL",
    "violation_has_evidence": "verdict = 'confirmed' AND n_violations > 0 AND n_evidence = 0",
    "not_claim_is_clean": "not_claim AND (verdict <> 'confirmed' OR n_violations > 0 OR n_spans > 0 OR subst_cap IS NOT NULL OR coalesce(risk, 0) > 0)",
    "encoder_on_hold": "encoder IS NOT NULL AND (verdict <> 'hold' OR not_claim)",
    "encoder_has_basis": "encoder IS NOT NULL AND encoder_basis IS NULL",
    "subst_for_b": "subst_cap IS NOT NULL AND infeasibility IS DISTINCT FROM 'B'",
    "subst_verdict": "subst_cap IS NOT NULL AND verdict NOT IN ('confirmed', 'hold')",
    "subst_hold_reason": "subst_cap IS NOT NULL AND verdict = 'hold' AND coalesce(hold_reason, '') NOT IN ('premise_unknown', 'low_conf')",
    "subst_has_risk": "subst_cap IS NOT NULL AND risk IS NULL",
    "subst_not_above": "subst_cap > risk",
    "answers_distinct": "answers = 'f2,f2'",
    "answers_place": f"answers <> '' AND verdict <> 'confirmed' AND NOT ({SHAKY}) AND NOT ({OPEN} AND (fact_kind IS NOT NULL OR subst_cap IS NOT NULL))",
    "asked_once": "fact_kind IS NOT NULL AND contains(answers, fact_kind)",
    "subst_answer_place": f"subst_answered AND (fact_kind IS NOT NULL OR NOT (verdict = 'confirmed' OR ({SHAKY})))",
    "question_for_claims": "fact_kind IS NOT NULL AND not_claim",
    "question_on_open_hold": f"fact_kind IS NOT NULL AND NOT ({OPEN}) AND NOT ({SHAKY})",
    "question_has_risk": "fact_kind IS NOT NULL AND risk IS NULL",
    "question_not_above": "fact_cap > risk",
}


@query(f"WITH {ROUTE}, r AS (SELECT sid, verdict, {', '.join(f'{x} AS {n}' for n, x in CONTRACT.items())} FROM v) " + " UNION ALL ".join(f"SELECT sid, '{n}' AS rule_id FROM r WHERE {x}" for n, x in BROKEN.items()))
def sentence_contract(spark, d):
    rows = _judged(spark, d).selectExpr("sid", "verdict", *[f"{x} AS {n}" for n, x in CONTRACT.items()])
    return J.breaches(rows.withColumn("answered", F.array_remove(F.split("answers", ","), "")), ["sid"], J.sentence_contract())


#: Responses, their sentences and branches, derived from keys so that every rule has rows that break it and rows that do not.
RESPONSE = {
    "outcome": "CASE conv_id % 5 WHEN 1 THEN 'certificate' WHEN 2 THEN 'guidance' WHEN 3 THEN 'passed' ELSE 'hold' END",
    "category": "CASE conv_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other_law' ELSE 'food' END",
    "category_source": "CASE WHEN conv_id % 7 > 0 AND conv_id % 11 > 0 OR conv_id % 21 = 0 THEN 'given' END",
    "n_not_reviewed": "CASE WHEN conv_id % 7 = 1 AND conv_id % 3 > 0 OR conv_id % 17 = 0 THEN 1 ELSE 0 END",
    "certificate": "CASE WHEN conv_id % 5 = 1 AND conv_id % 4 > 0 OR conv_id % 19 = 0 THEN substr('ABC', CAST(conv_id % 3 + 1 AS INT), 1) END",
    "n_candidates": "CASE WHEN conv_id % 13 IN (3, 4) THEN 2 ELSE 0 END",
    "attempt": "CASE WHEN conv_id % 23 = 0 THEN 1 ELSE 0 END",
}
PARTS = {
    "verdict": "CASE WHEN conv_id % 4 = 3 THEN 'confirmed' ELSE verdict END",
    "hold_reason": "CASE WHEN verdict = 'hold' AND conv_id % 4 <> 3 THEN CASE sid % 6 WHEN 0 THEN 'premise_unknown' WHEN 1 THEN 'cat_unknown' WHEN 2 THEN CASE WHEN conv_id % 8 = 1 THEN 'law_uncovered' ELSE 'low_conf' END ELSE 'low_conf' END END",
    "n_violations": "strong",
    "infeasibility": "CASE WHEN strong > 0 THEN CASE WHEN conv_id % 3 > 0 THEN 'B' ELSE substr('ABC', CAST(sid % 3 + 1 AS INT), 1) END END",
    "risk": "CASE WHEN sid % 13 > 0 THEN CASE WHEN conv_id % 6 = 3 THEN 0 ELSE least(strong, 3) END END",
    "n_spans": "CASE WHEN conv_id % 9 > 0 THEN 1 ELSE sid % 2 END",
    "subst": "conv_id % 9 <> 2",
    "asked": "sid % 9 IN (2, 3)",
    "denied": "sid % 10 = 0",
}
BRANCHES = {
    "premise": "CASE WHEN branch = 0 OR conv_id % 10 = 0 THEN 'food' ELSE 'care' END",
    "verified": "branch = 0 AND conv_id % 4 = 0 OR branch = 1 AND conv_id % 12 = 0",
    "sid": "CASE WHEN conv_id % 14 = 0 THEN -sid ELSE sid END",
    "risk": "CASE WHEN sid % 5 > 0 THEN CASE WHEN conv_id % 22 = 0 THEN 3 ELSE branch * (conv_id % 2) END END",
}


def _as(cols: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {n}" for n, x in cols.items())


def _where(table: str, when: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} WHERE {table}.conv_id = r.conv_id AND {when})"


#: Breaches, each as the condition under which a response r breaks its rule, over sentences q and branches b.
BROKEN_RESPONSE = {
    "certificate_given": "outcome = 'certificate' AND certificate IS NULL",
    "certificate_not_for_b": "outcome = 'certificate' AND certificate = 'B'",
    "certificate_alone": "outcome = 'certificate' AND n_candidates > 0",
    "certificate_only_then": "outcome <> 'certificate' AND certificate IS NOT NULL",
    "candidates_on_pass": "n_candidates > 0 AND outcome <> 'passed'",
    "candidates_not_for_a": "n_candidates > 0 AND " + _where("q", "infeasibility = 'A'"),
    "pass_is_clean": "outcome = 'passed' AND " + _where("q", "(verdict <> 'confirmed' OR risk IS NULL OR risk > 0)"),
    "one_round": "attempt <> 0",
    "guidance_is_settled": "outcome = 'guidance' AND " + _where("q", "verdict <> 'confirmed' AND NOT (verdict = 'hold' AND coalesce(hold_reason, '') = 'premise_unknown' AND (subst OR asked) AND risk IS NOT NULL)"),
    "guidance_without_ac": "outcome = 'guidance' AND " + _where("q", "infeasibility IN ('A', 'C')"),
    "guidance_has_b": "outcome = 'guidance' AND NOT " + _where("q", "infeasibility = 'B' AND n_violations > 0"),
    "guidance_says_how": "outcome = 'guidance' AND " + _where("q", "infeasibility = 'B' AND n_violations > 0 AND (NOT (subst OR denied) OR n_spans = 0)"),
    "one_verified": "(SELECT count(DISTINCT branch) FROM b WHERE b.conv_id = r.conv_id AND verified) > 1",
    "record_not_below": "NOT " + _where("b", "verified") + " AND EXISTS (SELECT 1 FROM b LEFT JOIN q ON q.sid = b.sid WHERE b.conv_id = r.conv_id AND b.risk IS NOT NULL AND NOT coalesce(q.risk >= b.risk, FALSE))",
    "hold_has_branches": _where("q", "hold_reason IN ('cat_unknown', 'premise_unknown') AND NOT subst AND NOT asked") + " AND NOT " + _where("b", "TRUE"),
    "premises_distinct": "(SELECT count(DISTINCT branch) > count(DISTINCT premise) FROM b WHERE b.conv_id = r.conv_id)",
    "branches_of_response": _where("b", "NOT EXISTS (SELECT 1 FROM q WHERE q.sid = b.sid)"),
    "notice_iff_uncovered": "(category IS NOT DISTINCT FROM 'other_law') <> (n_not_reviewed > 0)",
    "uncovered_never_passes": "category = 'other_law' AND outcome = 'passed'",
    "law_hold_where_uncovered": "category IS DISTINCT FROM 'other_law' AND " + _where("q", "hold_reason = 'law_uncovered'"),
    "category_has_source": "(category IS NULL) <> (category_source IS NULL)",
}


@query(f"WITH {ROUTE}, q AS (SELECT conv_id, turn, sid, {_as(PARTS)} FROM v), r AS (SELECT conv_id, {_as(RESPONSE)} FROM (SELECT DISTINCT conv_id FROM v)), b AS (SELECT conv_id, branch, {_as(BRANCHES)} FROM (SELECT conv_id, turn, sid, unnest([0, 1]) AS branch FROM v WHERE conv_id % 2 = 0 OR conv_id % 3 = 0)) " + " UNION ALL ".join(f"SELECT conv_id, '{n}' AS rule_id FROM r WHERE {x}" for n, x in BROKEN_RESPONSE.items()))
def response_contract(spark, d):
    """The rules of whole responses, over responses, sentences and branches made from the conversations."""
    v = _judged(spark, d)
    sentences = v.selectExpr("conv_id", "sid", *[f"{x} AS {n}" for n, x in PARTS.items()])
    responses = v.select("conv_id").distinct().selectExpr("conv_id", *[f"{x} AS {n}" for n, x in RESPONSE.items()])
    branches = v.where("conv_id % 2 = 0 OR conv_id % 3 = 0").select("conv_id", "sid", F.explode(F.array(F.lit(0), F.lit(1))).alias("branch")).selectExpr("conv_id", "branch", *[f"{x} AS {n}" for n, x in BRANCHES.items()])
    return C.response_contract(responses, sentences, branches, "conv_id", "sid", ["other_law"])


HEAD = "CASE WHEN strong > 1 THEN 'violation' WHEN caution THEN 'lawful' WHEN demoted > 0 THEN 'dropped' END"


@query(f"""WITH {SENT}, c AS (SELECT s.conv_id, regexp_replace(t.text, '\\s+', '', 'g') AS t, coalesce(last_value({HEAD} IGNORE NULLS) OVER (PARTITION BY s.conv_id ORDER BY s.turn), 'document') AS k FROM s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn),
    w AS (SELECT conv_id, CASE WHEN bool_or(k = 'violation') THEN 'violation' WHEN bool_or(k = 'lawful') THEN 'lawful' WHEN bool_or(k = 'dropped') THEN 'dropped' ELSE 'violation' END AS whole FROM c GROUP BY 1),
    p AS (SELECT DISTINCT conv_id, regexp_extract(text, '\\S+\\s+\\S+$') AS phrase FROM conversations),
    h AS (SELECT p.conv_id, p.phrase, whole, CASE k WHEN 'document' THEN whole ELSE k END AS k FROM p JOIN w USING (conv_id) LEFT JOIN c ON c.conv_id = p.conv_id AND p.phrase <> '' AND contains(c.t, regexp_replace(p.phrase, '\\s+', '', 'g')))
    SELECT conv_id, phrase, CASE WHEN bool_or(coalesce(k, whole) = 'violation') THEN 'violation' WHEN bool_or(coalesce(k, whole) = 'lawful') THEN 'lawful' ELSE 'dropped' END AS place FROM h GROUP BY 1, 2""")
def phrase_placement(spark, d):
    """The last two words of each turn as phrases, placed by the dispositions of the turns that contain them."""
    text = table(spark, d, "conversations").select("conv_id", "turn", "text")
    clauses = J.carry_forward(_sentences(spark, d).join(text, ["conv_id", "turn"]), "conv_id", "turn", F.expr(HEAD), "document")
    return J.place_phrases(clauses, text.select("conv_id", F.regexp_extract("text", r"\S+\s+\S+$", 0).alias("phrase")), "conv_id", "text", "phrase")
