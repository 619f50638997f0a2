"""Queries of governed loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import governance as G
from sparkloom.registry import query
from sparkloom.session import shared_folder, table
from sparkloom.sources.collections import collection
from sparkloom.sources import files


def _orders(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", *cols)


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND s_acctbal > 0")
def governed_scan(spark, d):
    """Source, use and permission: suppliers of nations in regions whose use is allowed."""
    use = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    allowed = F.col("r_name").isin("ASIA", "EUROPE")
    s = G.governed(table(spark, d, "supplier").where("s_acctbal > 0"), use, "s_nationkey", allowed)
    return s.join(F.broadcast(use), "s_nationkey").select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS citable FROM customer")
def governed_exists_flag(spark, d):
    pending = _orders(spark, d, "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return G.flag_exists(table(spark, d, "customer").select("c_custkey"), pending, "c_custkey", "citable")


@query("SELECT 'all' AS asked, count(*) AS n FROM customer UNION ALL SELECT 'two', count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) FROM customer")
def optional_set_filter(spark, d):
    c, seg = table(spark, d, "customer"), F.col("c_mktsegment")
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"]
    count = lambda name, wanted: c.where(G.optional_set(seg, wanted, known)).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
    return count("all", []).unionByName(count("two", ["BUILDING", "MACHINERY"]))


@query("SELECT c_custkey, o_orderkey AS latest FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE")
def lateral_latest_child(spark, d):
    from sparkloom.operators.analytics import latest_per

    last = latest_per(_orders(spark, d, "o_custkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, d, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("latest"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' AND o_totalprice > 100000")
def effective_current_rows(spark, d):
    """Rows in force: joined to their source, neither superseded nor excluded."""
    o = _orders(spark, d, "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").where("o_orderdate < '1998-01-01' AND o_orderstatus <> 'P' AND o_totalprice > 100000")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "o_custkey").join(F.broadcast(table(spark, d, "nation")), "n_nationkey").select("o_orderkey", "n_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) > DATE '1996-01-01' AND o_orderkey % 11 <> 0 END AS pending FROM orders")
def effective_date_split(spark, d):
    name = F.when(F.col("o_orderkey") % 7 == 0, "law").when(F.col("o_orderkey") % 11 == 0, "law_19000101").otherwise(F.concat(F.lit("law_"), F.date_format("o_orderdate", "yyyyMMdd")))
    return G.split_in_force(_orders(spark, d, "o_orderdate").withColumn("name", name), "name", F.lit("1996-01-01").cast("date")).select("o_orderkey", "pending")


OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _orders(spark, d, "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N"))


@query(f"WITH {OLD} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_merge(spark, d):
    return G.upsert(*_old_new(spark, d), ["o_orderkey"])


@query("SELECT DISTINCT k FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS k FROM orders WHERE o_orderstatus = 'P') WHERE k IS NOT NULL AND k NOT IN (SELECT sha256(CAST(o_custkey AS VARCHAR)) FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0) UNION ALL SELECT CAST(NULL AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 = 0")
def insert_if_absent(spark, d):
    o = _orders(spark, d, "o_custkey", "o_orderstatus").withColumn("k", F.sha2(F.col("o_custkey").cast("string"), 256))
    new = o.where("o_orderstatus = 'P'").select(F.when(F.col("o_custkey") % 5 != 0, F.col("k")).alias("k"))
    return G.insert_if_absent(o.where("o_orderstatus = 'F' AND o_custkey % 2 = 0").select("k"), new, "k")


@query(f"WITH {OLD} SELECT o_orderkey FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def sweep_orphans(spark, d):
    old, new = _old_new(spark, d)
    return G.orphans(old.select("o_orderkey"), new, ["o_orderkey"])


@query("WITH a AS (SELECT o_orderpriority AS p, count(*) AS n_stored FROM orders WHERE o_orderkey % 100 <> 0 GROUP BY 1), b AS (SELECT o_orderpriority AS p, count(*) AS n_expected FROM orders WHERE o_orderkey % 100 <> 0 OR o_orderpriority < '3' GROUP BY 1) SELECT coalesce(a.p, b.p) AS o_orderpriority, n_stored, n_expected FROM a FULL OUTER JOIN b ON a.p IS NOT DISTINCT FROM b.p WHERE n_stored IS DISTINCT FROM n_expected")
def readback_diff(spark, d):
    o = _orders(spark, d, "o_orderpriority")
    return G.readback_diff(o.where("o_orderkey % 100 <> 0"), o.where("o_orderkey % 100 <> 0 OR o_orderpriority < '3'"), ["o_orderpriority"])


@query("WITH a AS (SELECT o_orderpriority, count(*) AS before FROM orders GROUP BY 1), b AS (SELECT o_orderpriority, count(*) AS after FROM orders WHERE o_orderpriority < '5' AND (o_orderpriority <> '2-HIGH' OR o_orderkey % 10 <> 0) GROUP BY 1) SELECT o_orderpriority, before, coalesce(after, 0) AS after FROM a LEFT JOIN b USING (o_orderpriority) WHERE before - coalesce(after, 0) > 0.05 * before")
def shrink_ratchet(spark, d):
    o = _orders(spark, d, "o_orderpriority")
    return G.shrinkage(o, o.where("o_orderpriority < '5' AND (o_orderpriority <> '2-HIGH' OR o_orderkey % 10 <> 0)"), "o_orderpriority")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality END AS quality, CASE WHEN doc_id % 2 = 0 THEN toxic ELSE -1 END AS toxic FROM labels")
def sheet_carry_over(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    fresh = lab.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(-1).alias("toxic"))
    return G.carry_over(fresh, lab.where("doc_id % 2 = 0"), "doc_id", ["quality", "toxic"])


@query("""WITH l AS (SELECT o_orderkey, md5(CAST(o_totalprice AS INT)::VARCHAR) AS sha FROM orders WHERE o_orderkey % 5 <> 0), k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE md5(CAST(o_totalprice AS INT)::VARCHAR) END AS sha FROM orders WHERE o_orderkey % 3 <> 0),
    j AS (SELECT o_orderkey, l.sha AS ls, k.sha AS ks FROM l FULL OUTER JOIN k USING (o_orderkey)), s AS (SELECT o_orderkey, CASE WHEN ks IS NULL THEN 'missing' WHEN ls IS NULL THEN 'added' WHEN ls <> ks THEN 'changed' ELSE 'same' END AS state FROM j)
    SELECT o_orderkey, state, CASE WHEN state = 'missing' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'moved' WHEN o_orderkey % 2 = 0 THEN 'excluded' ELSE 'other' END END AS cause FROM s""")
def ledger_reconcile(spark, d):
    o = _orders(spark, d, "o_totalprice").withColumn("sha", F.md5(F.round("o_totalprice").cast("int").cast("string"))).drop("o_totalprice")
    disk = o.where("o_orderkey % 3 <> 0").withColumn("sha", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("sha")))
    return G.reconcile(o.where("o_orderkey % 5 <> 0"), disk, "o_orderkey", [("moved", F.col("o_orderkey") % 4 == 0), ("excluded", F.col("o_orderkey") % 2 == 0)]).select("o_orderkey", "state", "cause")


@query("""WITH f AS (SELECT doc_id, source, 'corpus/' || source || '/' || doc_id || CASE WHEN (doc_id // 20) % 10 = 7 AND lang = 'fr' THEN '.part' ELSE '.txt' END AS path, sha256(text) AS sha, n_chars AS size FROM documents),
    disk AS (SELECT path, sha, size FROM f WHERE (doc_id // 20) % 10 < 6 AND source <> 'src3' UNION ALL SELECT 'moved/' || doc_id || '.txt', sha, size FROM f WHERE (doc_id // 20) % 10 = 6
        UNION ALL SELECT 'corpus/' || source || '/new-' || doc_id || '.txt', sha256('new' || doc_id), size FROM f WHERE (doc_id // 20) % 10 = 8 AND source <> 'src3'),
    gone AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM f WHERE path NOT IN (SELECT path FROM disk)),
    here AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM disk), own AS (SELECT * FROM here WHERE path NOT IN (SELECT path FROM f))
    SELECT path, CASE WHEN sha IN (SELECT sha FROM disk) THEN 'moved' WHEN path LIKE 'corpus/%.part' THEN 'excluded' WHEN folder NOT IN (SELECT folder FROM here) THEN 'cleared'
        WHEN EXISTS (SELECT 1 FROM own WHERE own.folder = gone.folder AND own.size = gone.size) THEN 'replaced' ELSE 'lost' END AS cause FROM gone""")
def missing_causes(spark, d):
    """Documents as files of a ledger, and a disk on which some were moved, replaced or lost, and one folder was cleared; causes follow from hashes, paths and sizes."""
    k, src, slot = F.col("doc_id"), F.col("source"), F.expr("doc_id DIV 20 % 10")
    name = F.concat(F.lit("corpus/"), src, F.lit("/"), k.cast("string"), F.when((slot == 7) & (F.col("lang") == "fr"), ".part").otherwise(".txt"))
    f = table(spark, d, "documents").select("doc_id", "source", name.alias("path"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"))
    stays = f.where((slot < 6) & (src != "src3")).select("path", "sha", "size")
    moved = f.where(slot == 6).select(F.concat(F.lit("moved/"), k.cast("string"), F.lit(".txt")).alias("path"), "sha", "size")
    new = f.where((slot == 8) & (src != "src3")).select(F.concat(F.lit("corpus/"), src, F.lit("/new-"), k.cast("string"), F.lit(".txt")).alias("path"), F.sha2(F.concat(F.lit("new"), k.cast("string")), 256).alias("sha"), "size")
    return G.missing_causes(f.select("path", "sha", "size"), stays.unionByName(moved).unionByName(new), ["corpus/**.part"])


@query(r"""WITH o AS (SELECT doc_id, len(string_split(text, '. ')) AS n FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, len(regexp_split_to_array(text, '[.!?]\s')) AS n FROM documents WHERE doc_id % 11 <> 0),
    j AS (SELECT o.n AS a, n.n AS b, o.doc_id AS oi, n.doc_id AS ni FROM o FULL OUTER JOIN n USING (doc_id))
    SELECT count(*) FILTER (oi IS NULL) AS added, count(*) FILTER (ni IS NULL) AS gone, count(*) FILTER (oi = ni AND a <> b) AS changed, CAST(sum(a) AS BIGINT) AS old_total, CAST(sum(b) AS BIGINT) AS new_total,
        CAST(sum(b) FILTER (oi IS NULL) - sum(a) FILTER (ni IS NULL) AS BIGINT) AS source_caused, CAST(sum(b) FILTER (oi = ni) - sum(a) FILTER (oi = ni) AS BIGINT) AS rule_caused FROM j""")
def run_delta(spark, d):
    """Sentences of two runs over two editions of the corpus, of which the second also cuts by another rule."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.size(F.split("text", r"\. ")).alias("n"))
    return G.run_delta(old, docs.where("doc_id % 11 <> 0").select("doc_id", F.size(F.split("text", r"[.!?]\s")).alias("n")), "doc_id", "n")


@query(f"WITH {OLD} SELECT count(*) FILTER (n.o_orderkey IS NULL) AS only_a, count(*) FILTER (o.o_orderkey IS NULL) AS only_b, count(*) FILTER (n.o_orderkey = o.o_orderkey AND n.o_orderstatus IS DISTINCT FROM o.o_orderstatus) AS changed_o_orderstatus, count(*) FILTER (n.o_orderkey = o.o_orderkey AND n.o_totalprice IS DISTINCT FROM o.o_totalprice) AS changed_o_totalprice FROM old o FULL OUTER JOIN new n USING (o_orderkey)")
def run_diff(spark, d):
    return G.run_diff(*_old_new(spark, d), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"WITH {OLD} SELECT o.o_orderstatus AS was, n.o_orderstatus AS now, count(*) AS n FROM old o JOIN new n USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus GROUP BY 1, 2")
def class_moves(spark, d):
    return G.class_moves(*_old_new(spark, d), "o_orderkey", "o_orderstatus")


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR n_regionkey = 0")
def set_except(spark, d):
    """New claims: what is generated less (facts and input)."""
    n = table(spark, d, "nation")
    given = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(n.where("n_regionkey <> 0"), "n_nationkey").select("n_name")
    return n.select("n_name").exceptAll(given)


@query("SELECT n_nationkey AS k, 'only_a' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT s_nationkey + 100, 'only_b' FROM supplier WHERE s_acctbal < 0")
def sym_diff(spark, d):
    s = table(spark, d, "supplier")
    b = s.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct().unionByName(s.where("s_acctbal < 0").select((F.col("s_nationkey") + 100).alias("k")).distinct())
    return G.symmetric_difference(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), b)


@query("SELECT n_nationkey AS k, n_name AS name, 'nation' AS provenance FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def union_provenance(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return G.union_with_provenance({"nation": n, "region": r}, ["nation", "region"])


@query("SELECT CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0 THEN 'f' || (o_orderkey // 2) || '__c20240101' ELSE 'f' || o_orderkey END AS path, o_orderkey FROM orders WHERE NOT (o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0 AND (o_orderkey // 2) IN (SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 10 = 0 AND o_orderkey % 20 <> 0)))")
def edition_scan(spark, d):
    k = F.col("o_orderkey")
    path = F.when((k % 10 == 0) & (k % 20 != 0), F.concat(F.lit("f"), (k / 2).cast("long").cast("string"), F.lit("__c20240101"))).otherwise(F.concat(F.lit("f"), k.cast("string")))
    return files.editions(_orders(spark, d).withColumn("path", path), "path", allow=True).select("path", "o_orderkey")


PAGES = {
    "json": lambda items: F.to_json(F.struct("page", "total", F.col("items"))),
    "xml": lambda items: F.concat(F.lit("<list page='"), "page", F.lit("' total='"), "total", F.lit("'>"), items(lambda x: F.concat(F.lit("<item key='"), x["key"], F.lit("'><name>"), x["name"], F.lit("</name><balance>"), x["balance"], F.lit("</balance></item>"))), F.lit("</list>")),
    "html": lambda items: F.concat(F.lit("<html><head><meta name=page content="), "page", F.lit("><meta name=total content="), "total", F.lit("></head><script>key: 0</script>"), items(lambda x: F.concat(F.lit("<article><p>key: "), x["key"], F.lit("<p>name : "), x["name"], F.lit("<p>balance: "), x["balance"], F.lit("</article>"))), F.lit("</html>")),
}


@query("""SELECT kind, s_suppkey // 50 AS page, (SELECT count(*) FROM supplier) AS total, s_suppkey AS key, s_name AS name, CAST(CAST(s_acctbal * 100 AS BIGINT) AS VARCHAR) AS balance
    FROM supplier, (VALUES ('json'), ('xml'), ('html')) AS k(kind)""")
def page_collection(spark, d):
    """Suppliers written as paged JSON, XML and HTML files, one a page, and read back through the data source."""
    s = table(spark, d, "supplier")
    total = s.agg(F.count("*").alias("total"))
    item = F.struct(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal") * 100).cast("long").cast("string").alias("balance"))
    pages = s.groupBy(F.expr("s_suppkey DIV 50").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items")).crossJoin(F.broadcast(total))  # 50 suppliers a page; the total is one row
    work, out = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex[:12]}", None
    for kind, form in PAGES.items():
        text = pages.select(form(lambda f: F.array_join(F.transform("items", f), "")).alias("value"))
        text.write.option("maxRecordsPerFile", 1).text(f"{work}/{kind}")
        rows = collection(spark, f"{work}/{kind}", kind).select(F.lit(kind).alias("kind"), F.col("page").cast("long").alias("page"), "total", F.col("fields")["key"].cast("long").alias("key"), F.col("fields")["name"].alias("name"), F.col("fields")["balance"].alias("balance"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT l_orderkey AS path, arg_max(l_linenumber, l_linenumber) AS l_linenumber, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def ledger_last_row(spark, d):
    return files.ledger_last(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "path"), "path", "l_linenumber", ["l_partkey"])


@query("SELECT 15000 AS declared, count(*) AS rows, count(DISTINCT (o_custkey, o_orderstatus)) AS distinct_rows, count(DISTINCT o_orderkey % 40) AS pages, count(*) = 15000 AND count(DISTINCT (o_custkey, o_orderstatus)) = 15000 AS complete FROM orders")
def page_completeness(spark, d):
    return files.page_completeness(_orders(spark, d, "o_custkey", "o_orderstatus").select((F.col("o_orderkey") % 40).alias("page"), "o_custkey", "o_orderstatus"), "page", F.lit(15000))


@query("WITH s AS (SELECT *, length(text) < 200 AS short FROM conversations), p AS (SELECT *, coalesce(last_value(CASE WHEN NOT short THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS p FROM s) SELECT conv_id, p AS turn, count(*) AS parts, string_agg(text, ' ' ORDER BY turn) AS text FROM p GROUP BY conv_id, p")
def fold_short_leaf(spark, d):
    return G.fold_short(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", F.length("text") < 200, "text")


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_partkey <= lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), FALSE) AS broken FROM lineitem) SELECT *, bool_or(broken) OVER (PARTITION BY l_orderkey) AS blocked FROM l")
def outline_audit_lag(spark, d):
    return G.order_breaks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], "l_linenumber", "l_partkey")


NODES = "n AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '1.1' WHEN 3 THEN '1.1.1' WHEN 4 THEN '1.2' ELSE '1.2.' || l_linenumber END AS path, l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, first_value(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag) AS l_returnflag FROM lineitem))"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    path = F.when(n == 1, "1").when(n == 2, "1.1").when(n == 3, "1.1.1").when(n == 4, "1.2").otherwise(F.concat(F.lit("1.2."), n.cast("string")))
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")).select("l_orderkey", path.alias("path"), "l_returnflag")


@query(f"WITH {NODES} SELECT n.l_orderkey, n.path, n.l_returnflag, (SELECT arg_max(a.path, length(a.path)) FROM n a WHERE a.l_orderkey = n.l_orderkey AND a.l_returnflag = 'R' AND starts_with(n.path, a.path || '.')) AS ancestor FROM n")
def ancestor_nearest(spark, d):
    return G.nearest_ancestor(_nodes(spark, d), "l_orderkey", "path", F.col("l_returnflag") == "R").select("l_orderkey", "path", "l_returnflag", "ancestor")


@query(f"WITH {NODES} SELECT n.l_orderkey, n.path, (SELECT CASE WHEN count(*) = 0 THEN '' ELSE string_agg(a.path || ':' || a.l_returnflag, ' > ' ORDER BY length(a.path)) END FROM n a WHERE a.l_orderkey = n.l_orderkey AND starts_with(n.path, a.path || '.')) AS context FROM n")
def context_assembly(spark, d):
    """Titles of the ancestors from the top; '' where there is none to load."""
    n = _nodes(spark, d)
    a = n.select("l_orderkey", F.col("path").alias("a"), F.col("l_returnflag").alias("t"))
    hits = n.join(a, "l_orderkey").where(F.col("path").startswith(F.concat(F.col("a"), F.lit("."))))
    lines = hits.groupBy("l_orderkey", "path").agg(F.array_sort(F.collect_list(F.struct(F.length("a").alias("n"), F.concat("a", F.lit(":"), "t").alias("s")))).alias("l"))
    return n.join(lines, ["l_orderkey", "path"], "left").select("l_orderkey", "path", F.coalesce(F.array_join(F.transform("l", lambda x: x["s"]), " > "), F.lit("")).alias("context"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN printf('A%d-%d(%s)', l_orderkey, l_linenumber, l_returnflag) END AS citation, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS parsed FROM lineitem")
def citation_compose(spark, d):
    """A citation, null where a component is uncertain, and the line read back from it."""
    cite = F.when(F.col("l_returnflag") != "N", F.format_string("A%d-%d(%s)", "l_orderkey", "l_linenumber", "l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cite.alias("citation"), F.regexp_extract(cite, r"-([0-9]+)\(", 1).cast("int").alias("parsed"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'narrow_R1' END, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' END) AS kind FROM lineitem")
def citation_type(spark, d):
    """Lookup with a narrower override; unknown stays null."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    broad = spark.createDataFrame([("R", "returned"), ("A", "accepted")], "l_returnflag string, broad string")
    narrow = spark.createDataFrame([("R", 1, "narrow_R1")], "l_returnflag string, l_linenumber int, narrow string")
    return li.join(F.broadcast(broad), "l_returnflag", "left").join(F.broadcast(narrow), ["l_returnflag", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", F.coalesce("narrow", "broad").alias("kind"))


@query("SELECT s.s_suppkey, CASE WHEN c.c_custkey IS NULL THEN CASE WHEN s_nationkey > 12 THEN 'no number' ELSE 'not registered' END WHEN c_nationkey = s_nationkey THEN 'same' WHEN abs(c_nationkey - s_nationkey) < 5 THEN 'near' ELSE 'different' END AS verdict FROM supplier s LEFT JOIN customer c ON c.c_custkey = s.s_suppkey * 20")
def reference_identity(spark, d):
    """Label against reference by key, second axis equal or near, cause where there is no pair."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    far = F.abs(F.col("c_nationkey") - F.col("s_nationkey"))
    verdict = F.when(F.col("c_custkey").isNull(), F.when(F.col("s_nationkey") > 12, "no number").otherwise("not registered")).when(far == 0, "same").when(far < 5, "near").otherwise("different")
    return table(spark, d, "supplier").join(c, F.col("c_custkey") == F.col("s_suppkey") * 20, "left").select("s_suppkey", verdict.alias("verdict"))


@query("SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) = 'STANDARD' AND p_size > 25 THEN 'large standard' WHEN split_part(p_type, ' ', 1) = 'STANDARD' THEN NULL WHEN split_part(p_type, ' ', 1) = 'PROMO' THEN 'promotion' END AS reason FROM part")
def reason_lookup(spark, d):
    """Keyed lookup that never invents: no row gives null."""
    cells = spark.createDataFrame([("STANDARD", True, "large standard"), ("PROMO", True, "promotion"), ("PROMO", False, "promotion")], "k string, big boolean, reason string")
    p = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("k"), (F.col("p_size") > 25).alias("big"))
    return p.join(F.broadcast(cells), ["k", "big"], "left").select("p_partkey", "reason")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (1, 2, 3, 32, 35) AND l_linenumber IN (1, 3)")
def coordinate_fetch(spark, d):
    orders, lines = spark.createDataFrame([(k,) for k in (1, 2, 3, 32, 35)], "l_orderkey long"), spark.createDataFrame([(1,), (3,)], "l_linenumber int")
    return table(spark, d, "lineitem").join(F.broadcast(orders), "l_orderkey", "left_semi").join(F.broadcast(lines), "l_linenumber", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT s_suppkey, s_acctbal > 0 AND s_nationkey < 15 AS permitted, CASE WHEN s_acctbal <= 0 AND s_nationkey >= 15 THEN 'both' WHEN s_acctbal <= 0 THEN 'review' WHEN s_nationkey >= 15 THEN 'grade' END AS denied_by FROM supplier")
def registry_overlay(spark, d):
    """Matrix, review and grade: permitted only if every one says so."""
    s = table(spark, d, "supplier")
    review, grade = s.where("s_acctbal > 0").select("s_suppkey", F.lit(True).alias("ok")), table(spark, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("graded"))
    j = s.join(review, "s_suppkey", "left").join(F.broadcast(grade), "s_nationkey", "left")
    ok, graded = F.coalesce("ok", F.lit(False)), F.coalesce("graded", F.lit(False))
    return j.select("s_suppkey", (ok & graded).alias("permitted"), F.when(~ok & ~graded, "both").when(~ok, "review").when(~graded, "grade").alias("denied_by"))


@query("SELECT source, lang, sha256(string_agg('f' || doc_id || ' ' || sha256(text), chr(10) ORDER BY 'f' || doc_id || ' ' || sha256(text)))[1:12] AS bundle, count(*) AS files FROM documents GROUP BY 1, 2")
def bundle_sha(spark, d):
    return G.bundle_sha(table(spark, d, "documents"), ["source", "lang"], F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.sha2("text", 256))


@query(f"WITH {OLD} SELECT o_orderkey, o.o_orderstatus AS ours, n.o_orderstatus AS theirs FROM old o JOIN new n USING (o_orderkey) WHERE o.o_orderstatus <> n.o_orderstatus")
def ledger_conflicts(spark, d):
    return G.conflicts(*_old_new(spark, d), "o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey, CASE WHEN upper(replace(n_name, ' ', '')) IN ('FRANCE', 'GERMANY') THEN 'EU' WHEN upper(replace(n_name, ' ', '')) = 'JAPAN' THEN 'JP' END AS axis FROM nation")
def name_map(spark, d):
    """Name variants to an axis by the normalised key; unknown is null."""
    m = spark.createDataFrame([("FRANCE", "EU"), ("GERMANY", "EU"), ("JAPAN", "JP")], "k string, axis string")
    return table(spark, d, "nation").withColumn("k", F.upper(F.replace("n_name", F.lit(" "), F.lit("")))).join(F.broadcast(m), "k", "left").select("n_nationkey", "axis")


@query("SELECT k, coalesce(CAST(v AS VARCHAR), 'unregistered') AS version FROM (SELECT DISTINCT o_orderpriority AS k FROM orders) LEFT JOIN (SELECT o_orderpriority AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND o_orderpriority < '4' GROUP BY 1) USING (k)")
def latest_version(spark, d):
    o = _orders(spark, d, "o_orderpriority", "o_orderdate")
    last = o.where("o_orderdate <= '1995-06-01' AND o_orderpriority < '4'").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    return o.select("o_orderpriority").distinct().join(last, "o_orderpriority", "left").select(F.col("o_orderpriority").alias("k"), F.coalesce(F.col("v").cast("string"), F.lit("unregistered")).alias("version"))
