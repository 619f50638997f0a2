"""Queries of operations analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import analytics as A
from sparkloom.registry import query
from sparkloom.session import TABLES, table


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY o_orderstatus")
def share_by_status(spark, d):
    return A.share_by(table(spark, d, "orders"), "o_orderstatus")


@query("""SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events""")
def kpi_filtered_counts(spark, d):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"), at(F.min("ts")).alias("first_ts"), at(F.max("ts")).alias("last_ts"),
    )


@query("""SELECT CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'error_high' ELSE 'error_low' END WHEN event_type IN ('purchase', 'signup') THEN 'converted' ELSE 'other' END AS bucket, count(*) AS n
    FROM events GROUP BY 1""")
def case_groups(spark, d):
    e = F.col("event_type")
    bucket = F.when(e == "error", F.when(F.col("value") > 50, "error_high").otherwise("error_low")).when(e.isin("purchase", "signup"), "converted").otherwise("other")
    return table(spark, d, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('day', ts + INTERVAL 9 HOUR), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def kst_daily_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_format(A.local_bucket(F.col("ts"), "day"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT date_trunc('hour', ts + INTERVAL 9 HOUR) AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
    a AS (SELECT unnest(generate_series(date_trunc('hour', min(ts) + INTERVAL 9 HOUR), date_trunc('hour', max(ts) + INTERVAL 9 HOUR), INTERVAL 1 HOUR)) AS bucket FROM events)
    SELECT strftime(a.bucket, '%Y-%m-%d %H') AS hour, coalesce(n, 0) AS n FROM a LEFT JOIN b USING (bucket)""")
def zero_filled_series(spark, d):
    ev = table(spark, d, "events")
    ax = A.axis(ev.agg((F.min("ts") + A.kst()).alias("a"), (F.max("ts") + A.kst()).alias("z")), F.col("a"), F.col("z"), "hour")
    counts = ev.where("event_type = 'error'").groupBy(A.local_bucket(F.col("ts"), "hour").alias("bucket")).agg(F.count("*").alias("n"))
    return A.zero_filled(ax, counts, "n").select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour"), "n")


@query("""SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-20') AS current,
    count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY AND ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS previous FROM events""")
def period_over_period(spark, d):
    return A.period_over_period(table(spark, d, "events"), F.col("ts"), F.lit("2024-01-20").cast("timestamp_ntz"), "INTERVAL 7 DAYS")


@query("""WITH top AS (SELECT date_trunc('day', max(ts) + INTERVAL 9 HOUR) AS t FROM events), a AS (SELECT unnest(generate_series(t - INTERVAL 6 DAY, t, INTERVAL 1 DAY)) AS bucket FROM top),
    b AS (SELECT date_trunc('day', ts + INTERVAL 9 HOUR) AS bucket, count(*) AS n FROM events GROUP BY 1), s AS (SELECT bucket, coalesce(n, 0) AS n FROM a LEFT JOIN b USING (bucket))
    SELECT strftime(bucket, '%Y-%m-%d') AS day, n, round(n * 100 / greatest(1, max(n) OVER ()), 1) AS pct_of_max FROM s""")
def trailing7(spark, d):
    from pyspark.sql import Window

    ev = table(spark, d, "events")
    ax = A.axis(ev.agg((F.max("ts") + A.kst()).alias("z")), F.col("z") - F.expr("INTERVAL 6 DAYS"), F.col("z"), "day")
    counts = ev.groupBy(A.local_bucket(F.col("ts"), "day").alias("bucket")).agg(F.count("*").alias("n"))
    top = F.greatest(F.lit(1), F.max("n").over(Window.partitionBy()))
    return A.zero_filled(ax, counts, "n").select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), "n", F.round(F.col("n") * 100 / top, 1).alias("pct_of_max"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def topn_tiebreak(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("SELECT o_orderkey, o_custkey, 999 AS asked, (SELECT CAST(ceil(count(*) / 40) AS BIGINT) FROM orders WHERE o_orderstatus = 'F') AS page, (SELECT CAST(ceil(count(*) / 40) AS BIGINT) FROM orders WHERE o_orderstatus = 'F') AS pages, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE ceil(r / 40) = least(999, (SELECT ceil(count(*) / 40) FROM orders WHERE o_orderstatus = 'F'))")
def paged_list(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return A.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 999, 40).drop("o_totalprice").withColumn("asked", F.lit(999))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def pinned_first(spark, d):
    from sparkloom.operators.retrieval import ranked

    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), "o_orderdate")
    return ranked(o, [F.desc("pinned"), F.desc("o_orderdate"), F.asc("o_orderkey")], "place", 100).select("o_orderkey", "place")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def latest_per_key(spark, d):
    return A.latest_per(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1, 2 HAVING count(*) >= 3""")
def repeat_pattern(spark, d):
    return A.repeated_recent(table(spark, d, "events"), "user_id", "event_type", [F.desc("ts"), F.desc("event_id")])


@query("""WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'disabled' WHEN coalesce(last, TIMESTAMP '1992-01-01') < TIMESTAMP '1998-08-02' - INTERVAL 365 DAY THEN 'dormant' ELSE 'active' END AS status FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def status_case(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", A.status_case(F.col("c_acctbal") < 0, F.col("last"), day("1992-01-01"), day("1998-08-02")).alias("status"))


@query("SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_custkey = 42 OR c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'P'")
def owned_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.where((F.col("c_custkey") == 42) | ((F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderstatus") == "P"))).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("SELECT o.o_orderkey, c.c_name AS requester, s.s_name AS assignee FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN supplier s ON s.s_suppkey = o.o_orderkey % 150 WHERE o.o_orderstatus = 'P'")
def requester_assignee(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 150).alias("s_suppkey"))
    return o.join(table(spark, d, "customer"), "c_custkey").join(table(spark, d, "supplier"), "s_suppkey", "left").select("o_orderkey", F.col("c_name").alias("requester"), F.col("s_name").alias("assignee"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS func FROM events)
    SELECT event_id, other FROM (SELECT a.event_id, b.event_id AS other, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS r FROM e a JOIN e b
    ON a.func IS NOT DISTINCT FROM b.func AND a.user_id = b.user_id AND a.event_id <> b.event_id) WHERE r <= 10""")
def nullsafe_same_place(spark, d):
    """For each event the ten most recent others of the same user and place, where an unknown place equals an unknown one.

    The eleven latest events of a place hold the ten of each of its events, so a place costs its events once and no pairs.
    """
    from sparkloom.operators.retrieval import top_per

    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("func"))
    order = [F.desc("ts"), F.desc("event_id")]
    last = top_per(e, ["user_id", "func"], order, 11).groupBy("user_id", "func").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False).alias("last"))
    a, b = e.alias("a"), last.alias("b")
    same = F.col("a.func").eqNullSafe(F.col("b.func")) & (F.col("a.user_id") == F.col("b.user_id"))
    others = F.slice(F.filter("b.last", lambda x: x["event_id"] != F.col("a.event_id")), 1, 10)
    return a.join(b, same).select(F.col("a.event_id").alias("event_id"), F.explode(others["event_id"]).alias("other"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1998-01-01')")
def not_exists_insert(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderdate >= '1998-01-01'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(value, 0.99) AS DOUBLE) AS p99 FROM events GROUP BY 1""")
def nearest_rank_pct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[A.nearest_rank("value", q).alias(f"p{q}") for q in (50, 95, 99)])


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark, d):
    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES])


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) >= 20")
def kanon_floor(spark, d):
    return A.k_anonymous(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT event_type AS node, round(sum(value), 4) AS ms, count(*) AS calls FROM events GROUP BY 1")
def node_ms(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("node")).agg(F.round(F.sum("value"), 4).alias("ms"), F.count("*").alias("calls"))


@query("SELECT event_type, user_id % 3 AS branch, count(*) AS n, count(*) FILTER (value > 50) AS passed FROM events GROUP BY 1, 2")
def counters_snapshot(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("branch")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("passed"))
