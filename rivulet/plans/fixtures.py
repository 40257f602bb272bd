"""Inputs of the registered queries, derived from the driver's tables.

Every fixture is arithmetic on table columns (no random numbers), so the
DuckDB oracle can rebuild the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import input_mark, is_committed, table, work_dir
from rivulet.sources import topics

# The topic schemas and partition count of the fixtures.
PART_TOPIC_SCHEMA = "id bigint, name string, age int"
EVENT_TOPIC_SCHEMA = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
TOPIC_PARTITIONS = 3


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B rows: (id, name, age) from ``part``."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("age"))


def part_lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Fixture B: one topic line per part, keeping ``id`` (or other columns) alongside."""
    rows = part_rows(spark, sf_dir)
    return rows.select(*keep, topics.line_column(["id", "name", "age"], text_columns=["name"]).alias("value"))


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C: partition = id % 3, offset = id div 3 (dense per partition)."""
    lines = part_lines(spark, sf_dir)
    return lines.select(
        (F.col("id") % TOPIC_PARTITIONS).cast("int").alias("partition"),
        F.expr(f"id div {TOPIC_PARTITIONS}").alias("offset"),
        "value", "id")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D: events as topic lines, partition = event_id % 3, offset = event_id div 3."""
    e = table(spark, sf_dir, "events")
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return e.select(
        (F.col("event_id") % TOPIC_PARTITIONS).cast("int").alias("partition"),
        F.expr(f"event_id div {TOPIC_PARTITIONS}").alias("offset"),
        topics.line_column(cols, text_columns=topics.text_columns(e, cols)).alias("value"))


def stored_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D stored as a topic log, as a broker would hold it."""
    (log,) = _stored_once(spark, sf_dir, "event_log", ("events",), lambda s, d: {"log": event_log(s, d)})
    return log.select("partition", "offset", "value")


def kv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture A: key = l_linenumber, value = l_returnflag, plus measures."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity"), F.col("l_extendedprice"),
        F.col("l_returnflag").alias("value"), F.col("l_linenumber").alias("key"))


# --------------------------------------------------------------------- fixture F: rules
def customer_rule_tree(spark: SparkSession, sf_dir: str):
    """A rule tree grown from customer/nation/region: (rules, factors, children).

    Leaf ``c<custkey>``: key custkey % 3 - 1; factors c_nationkey (int) and,
    unless custkey % 5 = 0, c_mktsegment (str).  Some leaves have a note whose
    text holds separators, others the two factors that text would spell; some
    a limit that is no int, an int too large, or null.  ``n<nation>`` holds its
    customers at positions of 13 digits (even keys) or below zero (odd ones),
    ``r<region>`` its nations and again every customer with c_acctbal > 9000
    (repeated leaves), ``root`` the regions.  Every seventh nation has the key
    -1, which a multi rule must not have.
    """
    return _stored_once(spark, sf_dir, "rule_tree", ("customer", "nation", "region"), _customer_rule_tree)


def _customer_rule_tree(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    leaf = F.concat(F.lit("c"), key.cast("string"))
    nat = lambda k: F.concat(F.lit("n"), F.col(k).cast("string"))
    reg = lambda k: F.concat(F.lit("r"), F.col(k).cast("string"))
    multi = F.lit("multi").alias("kind")
    rules = (c.select(leaf.alias("rule_id"), F.lit("single").alias("kind"), ((key % 3) - 1).cast("int").alias("key"))
             .unionByName(n.select(nat("n_nationkey").alias("rule_id"), multi,
                                   F.when(F.col("n_nationkey") % 7 == 3, -1).otherwise(0).alias("key")))
             .unionByName(r.select(reg("r_regionkey").alias("rule_id"), multi, F.lit(1).alias("key")))
             .unionByName(spark.range(1).select(F.lit("root").alias("rule_id"), multi, F.lit(1).alias("key"))))

    def factor(pos: int, name: str, vtype: str, value, where=None) -> DataFrame:
        rows = c if where is None else c.where(where)
        return rows.select(leaf.alias("rule_id"), F.lit(pos).alias("pos"), F.lit(name).alias("name"),
                           F.lit(vtype).alias("vtype"), value.cast("string").alias("value"))

    limit = F.when(key % 11 == 0, "oops").when(key % 11 == 1, "99999999999999999999")
    factors = (factor(0, "c_nationkey", "int", F.col("c_nationkey"))
               .unionByName(factor(1, "c_mktsegment", "str", F.col("c_mktsegment"), key % 5 != 0))
               .unionByName(factor(2, "note", "str", F.lit("1;b=s:2"), key % 7 == 0))
               .unionByName(factor(2, "note", "str", F.lit("1"), key % 7 == 1))
               .unionByName(factor(3, "b", "str", F.lit("2"), key % 7 == 1))
               .unionByName(factor(4, "limit", "int", limit, key % 11 < 3)))
    cn = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    place = F.when(key % 2 == 0, F.lit(1234567890000) + key).otherwise(-key)
    children = (c.select(nat("c_nationkey").alias("parent_id"), place.cast("bigint").alias("pos"), leaf.alias("child_id"))
                .unionByName(n.select(reg("n_regionkey").alias("parent_id"),
                                      F.col("n_nationkey").cast("bigint").alias("pos"),
                                      nat("n_nationkey").alias("child_id")))
                .unionByName(cn.where(F.col("c_acctbal") > 9000).select(
                    reg("n_regionkey").alias("parent_id"), (F.col("c_custkey") + 1000).cast("bigint").alias("pos"),
                    leaf.alias("child_id")))
                .unionByName(r.select(F.lit("root").alias("parent_id"),
                                      F.col("r_regionkey").cast("bigint").alias("pos"),
                                      reg("r_regionkey").alias("child_id"))))
    return {"rules": rules, "factors": factors, "children": children}


def event_rules(spark: SparkSession, sf_dir: str):
    """Rules on fixture D: per event type an ALL rule (type and par = 0) and an ANY rule (type or its own slot).

    The slot of a type is its length, so the ANY rules of different types ask
    for different records.
    """
    return _stored_once(spark, sf_dir, "event_rules", ("events",), _event_rules)


def _event_rules(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    asked = types.select("event_type", F.explode(F.array(
        F.struct(F.lit("all").alias("mode"), F.lit(0).alias("key"), F.lit("par").alias("name"), F.lit("0").alias("value")),
        F.struct(F.lit("any").alias("mode"), F.lit(1).alias("key"), F.lit("slot").alias("name"),
                 F.length("event_type").cast("string").alias("value")))).alias("m"))
    asked = asked.select("event_type", F.concat(F.lit("e:"), "event_type", F.lit(":"), "m.mode").alias("rule_id"), "m.key", "m.name", "m.value")
    rules = asked.select("rule_id", F.lit("single").alias("kind"), "key")
    factors = asked.select("rule_id", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("event_type").alias("name"), F.lit("str").alias("vtype"), F.col("event_type").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.col("name"), F.lit("int").alias("vtype"), F.col("value")))).alias("f")).select("rule_id", "f.*")
    return {"rules": rules, "factors": factors}


_STORED: dict[tuple, tuple[str, list[str]]] = {}


def _stored_once(spark: SparkSession, sf_dir: str, label: str, inputs: tuple[str, ...], build) -> tuple[DataFrame, ...]:
    """Derived tables written once per application and state of their input tables, read back on each use."""
    key = (spark.sparkContext.applicationId, label, sf_dir, *[input_mark(spark, f"{sf_dir}/{t}.parquet") for t in inputs])
    path, names = _STORED.get(key, (None, []))
    if path is None or not all(is_committed(spark, f"{path}/{n}") for n in names):
        path = work_dir(spark, label)
        frames = build(spark, sf_dir)
        for name, df in frames.items():
            df.write.parquet(f"{path}/{name}")
        names = list(frames)
        _STORED[key] = (path, names)
    return tuple(spark.read.parquet(f"{path}/{n}") for n in names)


def event_records(spark: SparkSession, sf_dir: str):
    """Events seen as maps {event_type: str, par: int, slot: int} keyed by event_id."""
    from rivulet.operators.rules import unpivot_records
    e = table(spark, sf_dir, "events")
    return unpivot_records(e, "event_id", {"event_type": (F.col("event_type"), "str"),
                                           "par": (F.col("user_id") % 2, "int"),
                                           "slot": (F.col("user_id") % 20, "int")})
