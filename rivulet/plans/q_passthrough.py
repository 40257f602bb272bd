"""Coverage queries for what the reference reaches only by SQL pass-through (section 2B).

These are plain Spark built-ins, one query per category, written with the
DataFrame API (the SQL-text path itself is ``sql_text``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.plans.registry import make_registry
from rivulet.session import table

QUERIES, ORACLES, register = make_registry()


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


@register("pt_filter_project", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS disc_band,
       round(l_extendedprice * (1 - l_discount), 4) AS net
FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag LIKE 'A%' AND l_shipdate IS NOT NULL""")
def pt_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.where(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").like("A%")
                    & F.col("l_shipdate").isNotNull()).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("disc_band"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@register("pt_inner_join", """
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING'""")
def pt_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    return o.join(c.where(F.col("c_mktsegment") == "BUILDING"), o["o_custkey"] == c["c_custkey"]) \
        .select("o_orderkey", "c_name", "o_totalprice")


@register("pt_broadcast_join", """
SELECT p_brand, count(*) AS n_lines, round(sum(l_quantity), 4) AS sum_qty
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def pt_broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join with the part dimension; adaptive execution broadcasts it if its measured bytes allow."""
    li, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


@register("pt_outer_joins", """
WITH c AS (SELECT c_nationkey AS nk, count(*) AS n_cust FROM customer WHERE c_acctbal > 8000 GROUP BY 1),
     s AS (SELECT s_nationkey AS nk, count(*) AS n_supp FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
     cs AS (SELECT coalesce(c.nk, s.nk) AS nationkey, coalesce(n_cust, 0) AS n_cust, coalesce(n_supp, 0) AS n_supp
            FROM c FULL OUTER JOIN s ON c.nk = s.nk)
SELECT n.n_name, cs.nationkey, cs.n_cust, cs.n_supp
FROM cs LEFT JOIN nation n ON n.n_nationkey = cs.nationkey""")
def pt_outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("nk")) \
        .agg(F.count(F.lit(1)).alias("n_cust"))
    s = _t(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nk")) \
        .agg(F.count(F.lit(1)).alias("n_supp"))
    cs = c.join(s, "nk", "full").select(F.col("nk").alias("nationkey"),
                                       F.coalesce("n_cust", F.lit(0)).alias("n_cust"),
                                       F.coalesce("n_supp", F.lit(0)).alias("n_supp"))
    n = _t(spark, sf_dir, "nation")
    return cs.join(n, cs["nationkey"] == n["n_nationkey"], "left").select("n_name", "nationkey", "n_cust", "n_supp")


@register("pt_semi_join", """
SELECT * FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                                       AND o.o_totalprice > 200000)""")
def pt_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi")


@register("pt_anti_join", """
SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                                           AND o.o_orderstatus = 'F')""")
def pt_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")


@register("pt_range_join", """
SELECT c_custkey, s_suppkey, round(c_acctbal - s_acctbal, 4) AS diff
FROM customer JOIN supplier ON s_acctbal BETWEEN c_acctbal - 1.0 AND c_acctbal + 1.0""")
def pt_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band join |c_acctbal - s_acctbal| <= 1 as an equi-join on unit buckets plus a residual filter.

    Each supplier is placed in its bucket and the two neighbours, so the join
    is hash-partitioned on the bucket instead of a nested loop.
    """
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal",
                                             F.floor("c_acctbal").cast("bigint").alias("b"))
    s = _t(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_acctbal",
        F.explode(F.array(*[F.floor("s_acctbal").cast("bigint") + d for d in (-1, 0, 1)])).alias("b"))
    j = c.join(s, "b").where(F.col("s_acctbal").between(F.col("c_acctbal") - 1.0, F.col("c_acctbal") + 1.0))
    return j.select("c_custkey", "s_suppkey", F.round(F.col("c_acctbal") - F.col("s_acctbal"), 4).alias("diff"))


@register("pt_group_agg", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
       round(avg(o_totalprice), 4) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
FROM orders GROUP BY 1, 2""")
def pt_group_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"))


@register("pt_count_distinct", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts
FROM lineitem GROUP BY 1""")
def pt_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"))


@register("pt_rollup", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, count(*) AS n
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.count(F.lit(1)).alias("n"))


@register("pt_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def pt_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register("pt_grouping_sets", """
SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS bal
FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def pt_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").groupingSets(
        [["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@register("pt_window_rank", """
SELECT o_custkey, o_orderkey, o_totalprice,
       CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rnk,
       CAST(dense_rank() OVER w AS INTEGER) AS drnk,
       lag(o_totalprice) OVER w AS prev_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def pt_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn"),
                    F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("drnk"),
                    F.lag("o_totalprice").over(w).alias("prev_price"))


@register("pt_window_frame", """
SELECT event_id, user_id,
       CAST(round(100 * sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                         ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS BIGINT) AS moving_sum_cents,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_n,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS user_max
FROM events""")
def pt_window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row frames per user: 4-row moving sum, running count, whole-series max."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.round(100 * F.sum("value").over(w.rowsBetween(-3, 0))).cast("bigint").alias("moving_sum_cents"),
        F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_n"),
        F.max("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("user_max"))


@register("pt_topk", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def pt_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 by price with a full tie-break (the limit is the feature: a top-k report)."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice") \
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@register("pt_set_ops", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000
                              UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000
                                      INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000
                                   EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)""")
def pt_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    s_pos = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return (c.union(s).distinct().select(F.lit("union").alias("op"), "k")
            .unionByName(c.intersect(s).select(F.lit("intersect").alias("op"), "k"))
            .unionByName(c.subtract(s_pos).select(F.lit("except").alias("op"), "k")))


@register("pt_subquery", """
WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
SELECT c_custkey, c_name, c_acctbal FROM customer c
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
  AND c_custkey IN (SELECT o_custkey FROM big)
  AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')""")
def pt_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    avg_bal = c.agg(F.avg("c_acctbal")).scalar()
    big = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    open_ = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return (c.where(F.col("c_acctbal") > avg_bal).join(big, "c_custkey", "left_semi")
            .join(open_, "c_custkey", "left_semi").select("c_custkey", "c_name", "c_acctbal"))


@register("pt_scalar_functions", """
SELECT o_orderkey, upper(o_orderpriority) AS prio, substring(o_orderpriority, 1, 1) AS prio_no,
       CAST(length(o_orderpriority) AS INTEGER) AS prio_len, CAST(floor(o_totalprice) AS BIGINT) AS price_floor,
       CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       concat(o_orderstatus, '-', CAST(o_orderkey AS VARCHAR)) AS tag
FROM orders""")
def pt_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", F.upper("o_orderpriority").alias("prio"), F.substring("o_orderpriority", 1, 1).alias("prio_no"),
        F.length("o_orderpriority").alias("prio_len"), F.floor("o_totalprice").cast("bigint").alias("price_floor"),
        F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mon"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("month_start"),
        F.concat("o_orderstatus", F.lit("-"), F.col("o_orderkey").cast("string")).alias("tag"))


@register("pt_array_functions", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n_pos
FROM embeddings""")
def pt_array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.size("embedding").alias("dim"),
                    F.round(F.get("embedding", 0).cast("double"), 6).alias("first_value"),
                    F.size(F.filter("embedding", lambda x: x > 0)).alias("n_pos"))


@register("pt_json_functions", """
SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k,
       max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k
FROM events GROUP BY event_type""")
def pt_json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(
        F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))
