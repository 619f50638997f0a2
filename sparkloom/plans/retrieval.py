"""Queries of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import postings as P
from sparkloom.operators import retrieval as R
from sparkloom.operators.matching import contained
from sparkloom.registry import query
from sparkloom.session import table

TERMS = ["ther", "ration", "tion"]
WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
LAST = ", ".join(f"max(CASE WHEN starts_with(x, '{t}') THEN pos END) OVER up AS l{i}, count(*) FILTER (starts_with(x, '{t}')) OVER (PARTITION BY doc_id) AS c{i}" for i, t in enumerate(TERMS))
#: Covers by their definition: for each place, the latest place of each term up to it; the earliest of those begins the shortest run that ends there.
LEX = f"""w_ AS (SELECT doc_id, {WORDS} AS w FROM documents),
    x_ AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM w_),
    e_ AS (SELECT doc_id, pos, {LAST} FROM x_ WHERE {" OR ".join(f"starts_with(x, '{t}')" for t in TERMS)} WINDOW up AS (PARTITION BY doc_id ORDER BY pos)),
    p_ AS (SELECT doc_id, pos, least({", ".join(f"CASE WHEN c{i} = 0 THEN 2147483647 ELSE coalesce(l{i}, 0) END" for i in range(len(TERMS)))}) AS p FROM e_),
    k_ AS (SELECT doc_id, p, min(pos) - p + 1 AS size FROM p_ WHERE p > 0 GROUP BY doc_id, p),
    s_ AS (SELECT doc_id, CAST(sum(CASE WHEN size <= 16 THEN 1000000 ELSE 16000000 // size END) AS BIGINT) AS covers FROM k_ GROUP BY doc_id),
    t_ AS (SELECT DISTINCT doc_id, {" + ".join(f"(c{i} > 0)::INT" for i in range(len(TERMS)))} AS matched, {" + ".join(f"c{i}" for i in range(len(TERMS)))} AS tf FROM e_),
    lex AS (SELECT doc_id, source, lang, matched, tf, covers, round(covers / (covers + 1000000), 6) AS density FROM t_ JOIN s_ USING (doc_id) JOIN documents USING (doc_id))"""
VEC = """q_ AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    vec AS (SELECT vec_id, label, round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q::DOUBLE[], q::DOUBLE[])), 6) AS distance FROM embeddings, q_)"""
RANKS = f"""{LEX}, {VEC},
    l AS (SELECT doc_id, row_number() OVER (ORDER BY matched DESC, covers DESC, doc_id) AS rank_l FROM lex ORDER BY matched DESC, covers DESC, doc_id LIMIT 50),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank_r FROM vec WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY distance, vec_id LIMIT 50),
    fused AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, rank_l, rank_r, round(coalesce(1 / (60 + rank_l), 0) + coalesce(1 / (60 + rank_r), 0), 9) AS rrf FROM l FULL OUTER JOIN v ON l.doc_id = v.doc_id)"""


def lex_order():
    return (F.desc("matched"), F.desc("covers"), F.asc("doc_id"))


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return P.scores(P.index_of(spark, docs, "doc_id"), "doc_id", TERMS).join(docs.select("doc_id", "source", "lang"), "doc_id")


def _vector(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.vector_distances(e, e.where("vec_id = 0")).select("vec_id", "label", "distance")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    vec = R.ranked(_vector(spark, d).join(docs, "vec_id", "left_semi"), [F.asc("distance"), F.asc("vec_id")], "rank_r", R.POOL)
    lex = P.scores(P.index_of(spark, table(spark, d, "documents"), "doc_id"), "doc_id", TERMS)
    return R.fuse(R.ranked(lex, lex_order(), "rank_l", R.POOL).select("doc_id", "rank_l"), vec.select(F.col("vec_id").alias("doc_id"), "rank_r"), "doc_id")


@query(f"""WITH {RANKS},
    s AS (SELECT f.doc_id, d.source, rank_l, rank_r, rrf, row_number() OVER (PARTITION BY d.source ORDER BY rrf DESC, f.doc_id) AS n FROM fused f JOIN documents d USING (doc_id)),
    p AS (SELECT doc_id, source, rank_l, rank_r, rrf, row_number() OVER (ORDER BY n > 2, rrf DESC, doc_id) AS place FROM s)
    SELECT * FROM p WHERE place <= 10""")
def hybrid_search(spark, d):
    named = _fused(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.diversify(named, "source", [F.desc("rrf"), F.asc("doc_id")], pool=True).where("place <= 10").select("doc_id", "source", "rank_l", "rank_r", "rrf", "place")


@query(f"WITH {VEC} SELECT vec_id, label, distance FROM vec ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark, d):
    return _vector(spark, d).orderBy("distance", "vec_id").limit(10)


@query(f"WITH {VEC} SELECT vec_id, label, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rn FROM vec) WHERE rn <= 5")
def vector_topk_per_label(spark, d):
    return R.top_per(_vector(spark, d), ["label"], [F.asc("distance"), F.asc("vec_id")], 5)


@query(f"WITH {LEX} SELECT doc_id, source, matched, tf, density, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY matched DESC, covers DESC, doc_id) AS rn FROM lex) WHERE rn <= 3")
def lexical_topk_per_source(spark, d):
    return R.top_per(_lexical(spark, d), ["source"], lex_order(), 3).select("doc_id", "source", "matched", "tf", "density", "rn")


@query(f"WITH {LEX} SELECT doc_id, matched, tf, covers, density FROM lex")
def cover_density(spark, d):
    """Every document with one of the terms, scored from the terms' postings."""
    return P.scores(P.index_of(spark, table(spark, d, "documents"), "doc_id"), "doc_id", TERMS)


@query(f"WITH {RANKS} SELECT doc_id, rank_l, rank_r, rrf FROM fused")
def rrf_fuse_full_outer(spark, d):
    return _fused(spark, d).select("doc_id", "rank_l", "rank_r", "rrf")


@query(f"""WITH {LEX}, {VEC},
    l AS (SELECT doc_id, row_number() OVER (ORDER BY matched DESC, covers DESC, doc_id) AS rank_l FROM lex WHERE source = 'src0'),
    v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) AS rank_r FROM vec JOIN documents ON vec_id = documents.doc_id WHERE source = 'src0')
    SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, rank_l, rank_r, round(coalesce(1 / (60 + rank_l), 0) + coalesce(1 / (60 + rank_r), 0), 9) AS rrf FROM l FULL OUTER JOIN v ON l.doc_id = v.doc_id""")
def rrf_filter_then_fuse(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    vec = _vector(spark, d).select(F.col("vec_id").alias("doc_id"), "distance").join(docs, "doc_id")
    return R.law_view(_lexical(spark, d), vec, "doc_id", F.col("source") == "src0", lex_order(), [F.asc("distance"), F.asc("doc_id")]).select("doc_id", "rank_l", "rank_r", "rrf")


@query(f"WITH {LEX} SELECT doc_id, source, row_number() OVER (ORDER BY n > 2, matched DESC, covers DESC, doc_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY matched DESC, covers DESC, doc_id) AS n FROM lex)")
def diversify_cap(spark, d):
    return R.diversify(_lexical(spark, d), "source", lex_order()).select("doc_id", "source", "place")


GOLD = f"""WITH {LEX}, gold AS (SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY matched DESC, covers DESC, doc_id) AS rank FROM lex ORDER BY rank LIMIT 500),
    q AS (SELECT b.item_id, gold.doc_id, r.rank FROM benchmark b LEFT JOIN gold USING (item_id) LEFT JOIN r ON r.doc_id = gold.doc_id)"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    bench, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    gold = contained(docs.select("doc_id", F.col("text").alias("text_norm")), bench.select("item_id", F.col("text").alias("term_norm"))).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
    pool = R.ranked(_lexical(spark, d), lex_order(), "rank", 500).select("doc_id", "rank")
    return bench.select("item_id").join(gold, "item_id", "left").join(pool, "doc_id", "left")


@query(GOLD + " SELECT count(*) AS queries, count(rank) AS in_pool, count(*) FILTER (rank <= 100) AS in_top, count(*) FILTER (rank = 1) AS first, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM q")
def retrieval_quality_mrr(spark, d):
    return R.rank_quality(_gold(spark, d), 100)


@query(f"""WITH {RANKS} SELECT CASE WHEN rank_l IS NOT NULL AND rank_r IS NOT NULL THEN 'both' WHEN rank_l IS NOT NULL THEN 'lex_only' ELSE 'vec_only' END AS branch, count(*) AS n FROM fused GROUP BY 1""")
def branch_coverage(spark, d):
    b = F.when(F.col("rank_l").isNotNull() & F.col("rank_r").isNotNull(), "both").when(F.col("rank_l").isNotNull(), "lex_only").otherwise("vec_only")
    return _fused(spark, d).groupBy(b.alias("branch")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%thing%' ORDER BY lang, source NULLS LAST, doc_id LIMIT 50")
def literal_search(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike("%thing%")).select("doc_id", "lang", "source").orderBy("lang", F.asc_nulls_last("source"), "doc_id").limit(50)


def like_escape(text: str) -> str:
    """Text for use inside LIKE: backslash, percent and underscore stand for themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


@query(r"SELECT doc_id, text LIKE '%50\%%' ESCAPE '\' AS has_percent, contains(text, '%%') AS has_double, starts_with(text, 'The') AS starts_the FROM documents WHERE text LIKE '%\%\%%' ESCAPE '\'")
def like_escaped_search(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.like("%" + like_escape("%%") + "%")).select("doc_id", t.like("%" + like_escape("50%") + "%").alias("has_percent"), t.contains("%%").alias("has_double"), t.startswith("The").alias("starts_the"))


@query(f"""WITH {LEX}, {VEC} SELECT 'lexical' AS branch, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS state, count(*) AS pool, least(count(*), 5) AS top FROM lex
    UNION ALL SELECT 'vector', CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END, count(*), least(count(*), 5) FROM vec
    UNION ALL SELECT 'no_terms', 'no_terms', 0, 0""")
def search_state_envelope(spark, d):
    def state(df, name, none):
        n = F.count("*")
        return df.agg(F.lit(name).alias("branch"), F.when(n == 0, none).otherwise("ok").alias("state"), n.alias("pool"), F.least(n, F.lit(5)).alias("top"))

    nothing = P.scores(P.index_of(spark, table(spark, d, "documents"), "doc_id"), "doc_id", [])
    return state(_lexical(spark, d), "lexical", "empty").unionByName(state(_vector(spark, d), "vector", "empty")).unionByName(state(nothing, "no_terms", "no_terms"))


@query(f"""WITH {LEX}, f AS (SELECT *, row_number() OVER (ORDER BY matched DESC, covers DESC, doc_id) AS r FROM lex WHERE source IS NOT NULL),
    g AS (SELECT *, min(r) OVER (PARTITION BY source, lang) AS f1, row_number() OVER (PARTITION BY source, lang ORDER BY (doc_id % 2 = 0) DESC, r) AS n FROM f)
    SELECT doc_id, source, lang, pick FROM (SELECT *, row_number() OVER (ORDER BY f1) AS pick FROM g WHERE n = 1) WHERE pick <= 5""")
def pick_dedupe(spark, d):
    return R.pick_distinct(_lexical(spark, d), ["source", "lang"], lex_order(), (F.col("doc_id") % 2 == 0).cast("int"), 5).select("doc_id", "source", "lang", "pick")


@query(r"""WITH w AS (SELECT item_id, list_filter(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: w NOT IN ('the','and','of','to','in','is','a')) AS w FROM benchmark),
    u AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM w),
    s AS (SELECT item_id, k, CASE WHEN ends_with(w, 'ation') AND length(w) >= 7 THEN w[:-6] WHEN ends_with(w, 'ing') AND length(w) >= 5 THEN w[:-4] WHEN ends_with(w, 'ed') AND length(w) >= 4 THEN w[:-3]
        WHEN ends_with(w, 'es') AND length(w) >= 4 THEN w[:-3] WHEN ends_with(w, 's') AND length(w) >= 3 THEN w[:-2] ELSE w END AS t FROM u),
    f AS (SELECT item_id, t, min(k) AS k FROM s GROUP BY 1, 2)
    SELECT item_id, string_agg(t, ' ' ORDER BY k) AS terms, count(*) AS n FROM f GROUP BY 1""")
def order_preserving_distinct(spark, d):
    t = R.query_terms(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(t, " ").alias("terms"), F.size(t).cast("long").alias("n")).where("n > 0")


@query("""WITH p AS (SELECT vec_id, label, embedding[1:6]::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, unnest(e) AS prob, generate_subscripts(e, 1) AS k FROM p),
    k AS (SELECT vec_id, 'c' || k AS cls, prob FROM u WHERE round(prob, 6) >= 0.05)
    SELECT vec_id, string_agg(cls, ',' ORDER BY prob DESC, cls) AS ordered, arg_max(cls, prob) AS representative FROM k GROUP BY vec_id""")
def ordered_candidates(spark, d):
    """Candidates at or above the label's threshold, best first; the first represents the row."""
    probs = F.slice("embedding", 1, 6)
    pairs = F.transform(probs, lambda p, i: F.struct((-p.cast("double")).alias("neg"), F.concat(F.lit("c"), (i + 1).cast("string")).alias("cls")))
    kept = F.array_sort(F.filter(pairs, lambda x: F.round(-x["neg"], 6) >= 0.05))
    names = F.transform(kept, lambda x: x["cls"])
    return table(spark, d, "embeddings").select("vec_id", names.alias("n")).where(F.size("n") > 0).select("vec_id", F.array_join("n", ",").alias("ordered"), F.element_at("n", 1).alias("representative"))
