"""Registered queries for rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.operators import rules as R
from rivulet.plans import fixtures as fx
from rivulet.plans.registry import make_registry

QUERIES, ORACLES, register = make_registry()

# The customer rule tree of fixture F, in SQL.
_TREE_SQL = """
rules AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS rule_id, 'single' AS kind, CAST(c_custkey % 3 - 1 AS INTEGER) AS key
  FROM customer
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'multi', CASE WHEN n_nationkey % 7 = 3 THEN -1 ELSE 0 END FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'multi', 1 FROM region
  UNION ALL SELECT 'root', 'multi', 1),
factors AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS rule_id, f.pos, f.name, f.vtype, f.value
  FROM (SELECT c_custkey, unnest([
      {'ok': true, 'pos': 0, 'name': 'c_nationkey', 'vtype': 'int', 'value': CAST(c_nationkey AS VARCHAR)},
      {'ok': c_custkey % 5 <> 0, 'pos': 1, 'name': 'c_mktsegment', 'vtype': 'str', 'value': c_mktsegment},
      {'ok': c_custkey % 7 = 0, 'pos': 2, 'name': 'note', 'vtype': 'str', 'value': '1;b=s:2'},
      {'ok': c_custkey % 7 = 1, 'pos': 2, 'name': 'note', 'vtype': 'str', 'value': '1'},
      {'ok': c_custkey % 7 = 1, 'pos': 3, 'name': 'b', 'vtype': 'str', 'value': '2'},
      {'ok': c_custkey % 11 < 3, 'pos': 4, 'name': 'limit', 'vtype': 'int',
       'value': CASE c_custkey % 11 WHEN 0 THEN 'oops' WHEN 1 THEN '99999999999999999999' END}]) AS f FROM customer)
  WHERE f.ok),
children AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS parent_id,
         CAST(CASE WHEN c_custkey % 2 = 0 THEN 1234567890000 + c_custkey ELSE -c_custkey END AS BIGINT) AS pos,
         'c' || CAST(c_custkey AS VARCHAR) AS child_id FROM customer
  UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS BIGINT),
         'n' || CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR), CAST(c_custkey + 1000 AS BIGINT),
         'c' || CAST(c_custkey AS VARCHAR)
         FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000
  UNION ALL SELECT 'root', CAST(r_regionkey AS BIGINT), 'r' || CAST(r_regionkey AS VARCHAR) FROM region),
sigs AS (
  SELECT r.rule_id, r.key, coalesce(list({'name': f.name, 'type': CASE WHEN f.vtype = 'int' THEN 'number' ELSE 'text' END,
         'number': CASE WHEN f.vtype = 'int' THEN try_cast(f.value AS BIGINT) END,
         'text': CASE WHEN f.vtype <> 'int' OR try_cast(f.value AS BIGINT) IS NULL THEN f.value END}
         ORDER BY f.pos) FILTER (f.pos IS NOT NULL), []) AS signature
  FROM rules r LEFT JOIN factors f ON f.rule_id = r.rule_id WHERE r.kind = 'single' GROUP BY r.rule_id, r.key)"""

_WALK_SQL = """
walk(root_id, node_id, kind, depth, path) AS (
  SELECT 'root', c.child_id, k.kind, 1, [c.pos]
  FROM children c JOIN rules k ON k.rule_id = c.child_id WHERE c.parent_id = 'root'
  UNION ALL
  SELECT w.root_id, c.child_id, k.kind, w.depth + 1, list_append(w.path, c.pos)
  FROM walk w JOIN children c ON c.parent_id = w.node_id JOIN rules k ON k.rule_id = c.child_id
  WHERE w.kind = 'multi')"""


@register("rule_validate", f"""
WITH {_TREE_SQL}
SELECT r.rule_id, r.kind, r.key, CAST(count(f.pos) AS BIGINT) AS n_factors,
       CASE WHEN r.kind = 'multi' THEN 'multi rule with key -1' ELSE 'key -1 with 2 or more factors' END AS reason
FROM rules r LEFT JOIN factors f ON f.rule_id = r.rule_id
GROUP BY r.rule_id, r.kind, r.key
HAVING r.key = -1 AND (r.kind = 'multi' OR count(f.pos) >= 2)""")
def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that break the key/factor-count invariants."""
    rules, factors, _children = fx.customer_rule_tree(spark, sf_dir)
    return R.validate(rules, factors)


@register("rule_equality", f"""
WITH {_TREE_SQL}
SELECT rule_id, min(rule_id) OVER (PARTITION BY key, signature) AS class_id,
       count(*) OVER (PARTITION BY key, signature) AS class_size
FROM sigs""")
def rule_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: equality classes of single rules (same key, same factors position by position)."""
    rules, factors, _children = fx.customer_rule_tree(spark, sf_dir)
    return R.equality_classes(rules, factors)


@register("rule_flatten", f"""
WITH RECURSIVE {_TREE_SQL}, {_WALK_SQL}
SELECT root_id, node_id AS leaf_id, depth, path FROM walk WHERE kind = 'single'""")
def rule_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree under ``root`` unpacked to its leaf rules, depth-first paths, repeats kept."""
    rules, _factors, children = fx.customer_rule_tree(spark, sf_dir)
    return R.flatten(rules, children)


@register("rule_distinct", f"""
WITH RECURSIVE {_TREE_SQL}, {_WALK_SQL}
SELECT w.root_id, first(w.node_id ORDER BY w.path, w.node_id) AS leaf_id, first(w.path ORDER BY w.path) AS first_path,
       count(*) AS n_occurrences
FROM walk w JOIN sigs s ON s.rule_id = w.node_id WHERE w.kind = 'single'
GROUP BY w.root_id, s.key, s.signature""")
def rule_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened leaves de-duplicated by value, first occurrence kept."""
    rules, factors, children = fx.customer_rule_tree(spark, sf_dir)
    return R.distinct_leaves(R.flatten(rules, children), R.signatures(rules, factors))


@register("rule_match_atom", """
SELECT 'event_type' AS name, event_type AS value, event_id AS record_id FROM events
UNION ALL
SELECT 'par', '0', event_id FROM events WHERE user_id % 2 = 0
UNION ALL
SELECT DISTINCT 'slot', CAST(user_id % 20 AS VARCHAR), event_id FROM events
WHERE user_id % 20 IN (SELECT length(event_type) FROM events)""")
def rule_match_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose field equals a factor, for every factor of the event rules."""
    _rules, factors = fx.event_rules(spark, sf_dir)
    return R.match_atoms(fx.event_records(spark, sf_dir), factors)


@register("rule_match_all", """
SELECT 'e:' || event_type || ':all' AS rule_id, event_id AS record_id FROM events WHERE user_id % 2 = 0""")
def rule_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 with key 0: a record matches when every factor holds."""
    rules, factors = fx.event_rules(spark, sf_dir)
    return R.match_rules(fx.event_records(spark, sf_dir), rules.where("key = 0"), factors)


@register("rule_match_any", """
SELECT 'e:' || t.event_type || ':any' AS rule_id, e.event_id AS record_id
FROM (SELECT DISTINCT event_type FROM events) t
JOIN events e ON e.event_type = t.event_type OR e.user_id % 20 = length(t.event_type)""")
def rule_match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 with key 1: a record matches when at least one factor holds."""
    rules, factors = fx.event_rules(spark, sf_dir)
    return R.match_rules(fx.event_records(spark, sf_dir), rules.where("key = 1"), factors)
