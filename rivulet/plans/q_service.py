"""Registered queries for the SQL service (V1-V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.operators import service as V
from rivulet.plans.registry import make_registry
from rivulet.session import register_tables

QUERIES, ORACLES, register = make_registry()

_Q1 = """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= {ts}
GROUP BY l_returnflag, l_linestatus"""


@register("sql_text", _Q1.format(ts="TIMESTAMP '2000-12-01 00:00:00'"))
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: SQL text submitted as-is over the registered tables."""
    register_tables(spark, sf_dir, ["lineitem"])
    return V.run_sql(spark, _Q1.format(ts="TIMESTAMP_NTZ '2000-12-01 00:00:00'"))


@register("result_json", """
SELECT chunk_no,
       CAST(to_json({'response': {'msg': 'get result succeed', 'resultCode': 0},
                     'data': list(txt ORDER BY i)}) AS VARCHAR) AS json
FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk_no,
             row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
             '[' || CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ','
                 || CAST(o_totalprice AS VARCHAR) || ']' AS txt
      FROM orders)
GROUP BY chunk_no""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a query's whole result as JSON documents of at most 1,000 row texts each."""
    register_tables(spark, sf_dir, ["orders"])
    res = V.run_sql(spark, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
    return V.json_chunks(res, ["o_orderkey"], chunk_rows=1000)
