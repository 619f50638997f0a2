"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import metrics as M
from sparkloom.registry import query
from sparkloom.session import table

#: Two kinds of finding of a document: predicted by rules on its text, true by its labels.
PRED = "pred AS (SELECT doc_id, 'low' AS kind FROM documents WHERE regexp_matches(text, '[%&#$*]{3,}|!!') UNION ALL SELECT doc_id, 'toxic' FROM documents WHERE regexp_matches(text, '[?!]') UNION ALL SELECT doc_id, 'number' FROM documents WHERE regexp_matches(text, '[0-9]{6,}'))"
GOLD = "gold AS (SELECT doc_id, 'low' AS kind FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"
PRF = f"""{PRED}, {GOLD}, p AS (SELECT * FROM pred WHERE doc_id IN (SELECT doc_id FROM labels)), j AS (SELECT coalesce(p.kind, g.kind) AS kind, p.doc_id AS p, g.doc_id AS g FROM p FULL OUTER JOIN gold g ON p.doc_id = g.doc_id AND p.kind = g.kind),
    c AS (SELECT kind, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY kind),
    s AS (SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c)"""


def _pred(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    kinds = F.array_compact(F.array(F.when(t.rlike("[%&#$*]{3,}|!!"), "low"), F.when(t.rlike("[?!]"), "toxic"), F.when(t.rlike("[0-9]{6,}"), "number")))
    lab = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").select("doc_id", kinds.alias("kinds")).join(lab, "doc_id", "left_semi")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic")))
    return table(spark, d, "labels").select("doc_id", kinds.alias("kinds"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda df: df.select("doc_id", F.explode("kinds").alias("kind"))
    return M.prf(rows(_pred(spark, d)), rows(_gold(spark, d)), "doc_id", "kind")


@query(f"WITH {PRF} SELECT * FROM s")
def prf_per_class(spark, d):
    return _scores(spark, d)


@query(f"WITH {PRF} SELECT round(avg(f1) FILTER (tp + fn >= 30), 6) AS macro_f1, count(*) FILTER (tp + fn >= 30) AS measurable, count(*) FILTER (tp + fn < 30) AS unmeasurable, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM s")
def macro_micro(spark, d):
    return M.averages(_scores(spark, d))


SETS = f"""{PRED}, {GOLD}, sets AS (SELECT l.doc_id, coalesce(list(DISTINCT p.kind) FILTER (p.kind IS NOT NULL), []) AS p, coalesce(list(DISTINCT g.kind) FILTER (g.kind IS NOT NULL), []) AS g FROM labels l JOIN documents USING (doc_id) LEFT JOIN pred p ON p.doc_id = l.doc_id LEFT JOIN gold g ON g.doc_id = l.doc_id GROUP BY l.doc_id)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return _pred(spark, d).withColumnRenamed("kinds", "p").join(_gold(spark, d).withColumnRenamed("kinds", "g"), "doc_id")


@query(f"WITH {SETS}, h AS (SELECT list_has_any(p, ['low', 'toxic']) AS ip, list_has_any(g, ['low', 'toxic']) AS ig, list_has_any(list_intersect(p, g), ['low', 'toxic']) AS hit FROM sets), c AS (SELECT count(*) FILTER (hit) AS tp, count(*) FILTER (ip AND NOT hit) AS fp, count(*) FILTER (ig AND NOT hit) AS fn FROM h) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c")
def group_prf(spark, d):
    return M.group_prf(_sets(spark, d), "p", "g", ["low", "toxic"])


@query("""WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY source UNION ALL SELECT 'none', 0, 0),
    w AS (SELECT source, n, k, CASE WHEN n > 0 THEN k / n END AS p FROM g)
    SELECT source, n, k, CASE WHEN n > 0 THEN round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) END AS lo,
    CASE WHEN n > 0 THEN round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) END AS hi FROM w""")
def wilson_ci(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    none = spark.createDataFrame([("none", 0, 0)], "source string, n long, k long")
    n = F.nullif("n", F.lit(0))
    lo, hi = M.wilson(F.col("k"), n)
    return g.unionByName(none).select("source", "n", "k", lo.alias("lo"), hi.alias("hi"))


@query("""WITH b AS (SELECT quality AS a, CASE WHEN regexp_matches(text, '[%&#$*]{3,}|!!') THEN 0 ELSE 1 END AS b FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM b),
    x AS (SELECT sum(na * nb) AS c FROM (SELECT a AS v, count(*) AS na FROM b GROUP BY 1) JOIN (SELECT b AS v, count(*) AS nb FROM b GROUP BY 1) USING (v))
    SELECT n, round(same / n, 6) AS po, round(c / (n * n), 6) AS pe, CASE WHEN c / (n * n) < 1 THEN round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) END AS kappa FROM n, x""")
def cohen_kappa(spark, d):
    rule = F.when(F.col("text").rlike("[%&#$*]{3,}|!!"), 0).otherwise(1)
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", rule.alias("b")), "doc_id").select(F.col("quality").alias("a"), "b")
    return M.kappa(both, "a", "b")


@query(f"""WITH {SETS}, a AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN ['out'] ELSE p END AS p, CASE WHEN len(g) = 0 THEN ['out'] ELSE g END AS g FROM sets)
    SELECT doc_id, 2 AS annotators, CASE WHEN list_contains(p, 'out') OR list_contains(g, 'out') THEN CASE WHEN list_contains(p, 'out') AND list_contains(g, 'out') THEN 'agreed' ELSE 'split' END
    WHEN len(list_intersect(p, g)) = len(list_distinct(list_concat(p, g))) THEN 'agreed' WHEN len(list_intersect(p, g)) > 0 THEN 'partial' ELSE 'split' END AS state FROM a""")
def agreement_classes(spark, d):
    s, out = _sets(spark, d), F.array(F.lit("out"))
    one = lambda c: s.select("doc_id", F.when(F.size(c) == 0, out).otherwise(F.col(c)).alias("labels"))
    return M.agreement(one("p").unionByName(one("g")), "doc_id", "labels", "out")


@query(f"WITH {SETS} SELECT doc_id, array_to_string(list_sort(CASE WHEN len(list_intersect(['low'], p)) >= len(list_intersect(['toxic', 'number'], p)) THEN ['low'] ELSE ['toxic', 'number'] END), ',') AS truth FROM sets")
def best_truth(spark, d):
    alternatives = F.array(F.array(F.lit("low")), F.array(F.lit("toxic"), F.lit("number")))
    return _sets(spark, d).select("doc_id", F.array_join(F.array_sort(M.best_alternative(F.col("p"), alternatives)), ",").alias("truth"))


@query(f"WITH {SETS}, u AS (SELECT doc_id, unnest(CASE WHEN len(p) = 0 THEN ['none'] ELSE p END) AS reason FROM sets) SELECT reason, count(*) AS n FROM u GROUP BY 1")
def outcome_distribution(spark, d):
    """A row with k reasons counts k times."""
    s = _sets(spark, d)
    return s.select(F.explode(F.when(F.size("p") == 0, F.array(F.lit("none"))).otherwise(F.col("p"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {SETS} SELECT count(*) FILTER (len(p) > 0 AND len(list_intersect(p, g)) = 0) AS wrong_confirm, count(*) FILTER (len(g) = 0 AND len(p) > 0) AS lawful_flagged, count(*) FILTER (len(list_intersect(p, g)) > 0 AND len(p) = 1) AS confirmed, count(*) FILTER (len(list_intersect(p, g)) > 0) AS with_candidates, count(*) FILTER (len(g) > 0) AS violations FROM sets")
def wrong_confirm(spark, d):
    hit = F.size(F.array_intersect("p", "g")) > 0
    return _sets(spark, d).agg(
        F.count_if((F.size("p") > 0) & ~hit).alias("wrong_confirm"), F.count_if((F.size("g") == 0) & (F.size("p") > 0)).alias("lawful_flagged"),
        F.count_if(hit & (F.size("p") == 1)).alias("confirmed"), F.count_if(hit).alias("with_candidates"), F.count_if(F.size("g") > 0).alias("violations"),
    )


@query("SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS axis, coalesce(lang, source, 'all') AS key, count(*) AS n, count(*) FILTER (quality = 0) AS negatives, count(*) < 30 AS unmeasurable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def split_tallies(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    g = j.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"), F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("negatives"))
    axis = F.when(F.col("gl") == 0, "lang").when(F.col("gs") == 0, "source").otherwise("all")
    return g.select(axis.alias("axis"), F.coalesce("lang", "source", F.lit("all")).alias("key"), "n", "negatives", (F.col("n") < 30).alias("unmeasurable"))


@query("WITH a AS (SELECT source, count(*) AS found FROM documents WHERE source <> 'src1' GROUP BY 1), b AS (SELECT source, count(*) AS baseline FROM documents WHERE doc_id % 50 <> 0 OR source <> 'src2' GROUP BY 1) SELECT coalesce(a.source, b.source) AS source, coalesce(found, 0) AS found, coalesce(baseline, 0) AS baseline FROM a FULL OUTER JOIN b ON a.source = b.source WHERE coalesce(found, 0) <> coalesce(baseline, 0)")
def shape_audit(spark, d):
    """Counts against a baseline in both directions; a vanished table differs too."""
    doc = table(spark, d, "documents")
    a = doc.where("source <> 'src1'").groupBy("source").agg(F.count("*").alias("found"))
    b = doc.where("doc_id % 50 <> 0 OR source <> 'src2'").groupBy("source").agg(F.count("*").alias("baseline"))
    j = a.join(b, "source", "full_outer").select("source", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("baseline", F.lit(0)).alias("baseline"))
    return j.where("found <> baseline")


GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
SCORED = "x AS (SELECT lang, least(1, round((length(text) - length(regexp_replace(text, '[%&#$*!]', '', 'g'))) * 4 / length(text), 6)) AS score, 1 - quality AS bad FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    s = F.least(F.lit(1.0), F.round((F.length(t) - F.length(F.regexp_replace(t, "[%&#$*!]", ""))) * 4 / F.length(t), 6))
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", "lang", s.alias("score")).join(table(spark, d, "labels"), "doc_id").select("lang", "score", (1 - F.col("quality")).alias("bad"))


@query(f"WITH {SCORED}, c AS (SELECT lang, count(*) FILTER (bad = 1) AS pos, " + ", ".join(f"count(*) FILTER (bad = 1 AND score >= {t}) AS t{i}" for i, t in enumerate(GRID)) + " FROM x GROUP BY lang) SELECT lang, pos, CASE WHEN pos < 10 THEN 0.5 ELSE greatest(" + ", ".join(f"CASE WHEN t{i} >= 0.6 * pos THEN {t} END" for i, t in enumerate(GRID)) + ") END AS threshold FROM c")
def matched_threshold(spark, d):
    return M.matched_threshold(_scored(spark, d), "lang", "score", "bad", 0.6, GRID)


@query(f"WITH {SCORED}, g AS (SELECT unnest({GRID}) AS threshold) SELECT threshold, count(*) FILTER (score >= threshold AND bad = 1) AS detected, count(*) FILTER (score < threshold AND bad = 1) AS missed, count(*) FILTER (score >= threshold AND bad <> 1) AS flagged, count(*) FILTER (score < threshold AND bad <> 1) AS quiet FROM x, g GROUP BY 1")
def threshold_sweep(spark, d):
    return M.sweep(_scored(spark, d), "score", "bad", GRID)


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN NULL ELSE (CASE WHEN s_acctbal < 0 THEN 3 ELSE 0 END) + (CASE WHEN s_nationkey > 15 THEN 2 ELSE 0 END) + (CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END) END AS points, concat_ws(',', CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey > 15 THEN 'nation' END, CASE WHEN s_suppkey % 10 = 0 THEN 'round' END) AS reasons FROM supplier")
def risk_points(spark, d):
    """Additive points with their reasons; the exempt grade is never scored."""
    rules = [("balance", 3, F.col("s_acctbal") < 0), ("nation", 2, F.col("s_nationkey") > 15), ("round", 1, F.col("s_suppkey") % 10 == 0)]
    points = sum((F.when(c, n).otherwise(0) for _, n, c in rules), F.lit(0))
    return table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") != 0, points).alias("points"), F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, _, c in rules])), ",").alias("reasons"))


@query("""WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'bad' END AS first, CASE WHEN doc_id % 9 = 0 THEN 'bad' WHEN quality = 1 THEN 'ok' ELSE 'bad' END AS second, CASE WHEN doc_id % 18 = 0 THEN 'ok' END AS decided FROM labels)
    SELECT doc_id, first <> second AS to_panel, coalesce(CASE WHEN first <> second THEN decided END, CASE WHEN first = second THEN first END) AS final FROM a""")
def adjudication(spark, d):
    """Only split rows go to the panel; its decisions win."""
    one = F.when(F.col("quality") == 1, "ok").otherwise("bad")
    a = table(spark, d, "labels").select("doc_id", one.alias("first"), F.when(F.col("doc_id") % 9 == 0, "bad").otherwise(one).alias("second"), F.when(F.col("doc_id") % 18 == 0, "ok").alias("decided"))
    split = F.col("first") != F.col("second")
    return a.select("doc_id", split.alias("to_panel"), F.coalesce(F.when(split, F.col("decided")), F.when(~split, F.col("first"))).alias("final"))


@query("""WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, quality, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 11 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'missing' WHEN a.quality IS NOT DISTINCT FROM b.quality AND a.toxic IS NOT DISTINCT FROM b.toxic THEN CASE WHEN a.toxic = 1 AND a.quality = 0 THEN 'sheet' ELSE 'adopted' END ELSE 'sheet' END AS way FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def two_reader(spark, d):
    """Adopted where both readings are equal and the guard passes; else to the sheet; a missing reading is named."""
    lab = table(spark, d, "labels")
    a = lab.where("doc_id % 7 <> 0").select("doc_id", F.struct("quality", "toxic").alias("a"))
    b = lab.where("doc_id % 11 <> 0").select("doc_id", F.struct("quality", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic")).alias("b"))
    guard = ~((F.col("a.toxic") == 1) & (F.col("a.quality") == 0))
    way = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")) & guard, "adopted").otherwise("sheet")
    return a.join(b, "doc_id", "full_outer").select("doc_id", way.alias("way"))


@query("WITH p AS (SELECT vec_id, label, [(embedding[1])::DOUBLE, embedding[2], embedding[3]] AS p FROM embeddings) SELECT vec_id, round(least(1.0, greatest(p[1] / 0.3, p[2] / 0.2, CASE WHEN label <> 0 THEN p[3] / 0.25 END)), 6) AS closeness FROM p")
def closeness(spark, d):
    """Largest probability over its threshold, without labels that cannot apply or whose threshold is above 1; at most 1."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    thresholds = [0.3, 0.2, 0.25, 1.5]
    shares = F.array(*[F.when(F.col("label") != 0, e(k) / t) if k == 2 else e(k) / t for k, t in enumerate(thresholds) if t <= 1])
    return table(spark, d, "embeddings").select("vec_id", F.round(F.least(F.lit(1.0), F.array_max(shares)), 6).alias("closeness"))


@query(f"WITH {SETS}, c AS (SELECT CASE WHEN len(p) = 0 AND len(g) = 0 THEN 'none' WHEN len(g) = 0 THEN 'dict_only' WHEN len(p) = 0 THEN 'enc_only' WHEN len(list_intersect(p, g)) > 0 THEN 'agree' ELSE 'differ' END AS cell FROM sets) SELECT cell, count(*) AS n FROM c GROUP BY 1")
def combo_cells(spark, d):
    cell = F.when((F.size("p") == 0) & (F.size("g") == 0), "none").when(F.size("g") == 0, "dict_only").when(F.size("p") == 0, "enc_only").when(F.arrays_overlap("p", "g"), "agree").otherwise("differ")
    return _sets(spark, d).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


STEPS = [("all", "true"), ("paid", "o_totalprice > 50000"), ("recent", "o_orderdate >= TIMESTAMP '1995-01-01'"), ("open", "o_orderstatus = 'O'")]


@query(" UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS name, count(*) FILTER ({' AND '.join(c for _, c in STEPS[: i + 1])}) AS n FROM orders" for i, (n, _) in enumerate(STEPS)))
def funnel(spark, d):
    when = {"all": F.lit(True), "paid": F.col("o_totalprice") > 50000, "recent": F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), "open": F.col("o_orderstatus") == "O"}
    return M.funnel(table(spark, d, "orders"), [(n, when[n]) for n, _ in STEPS])
