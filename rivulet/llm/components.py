"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import stored


#: A node with more than this share of the rows is a hub; there are at most so many, so they are broadcast.
HUB_SHARE = 1000


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """``rows(a, b)`` with ``m``, the least ``b`` of their ``a`` or ``a`` itself; a hub's rows stay where they are."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    hubs = least.where(F.col("n") * HUB_SHARE > total).select("a", F.col("m").alias("hub"))
    wide = rows.join(F.broadcast(hubs), "a", "left")
    others = wide.where("hub IS NULL").select("a", "b").join(least.select("a", "m"), "a")
    return wide.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("m")).unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; ``root`` is the least node reachable.

    Alternating large-star and small-star steps: a node hands its neighbours
    only the least node it knows, so a hub costs one row per neighbour.  Each
    step is written to the shared folder; they end when the links no longer
    change.  Self links are allowed; an empty table gives an empty result.
    """
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    alone = edges.where("a = b").select("a")
    before, now = None, _mark(edges)
    while now != before:
        # Large star: neighbours above a node link to the least of it and its neighbours.
        both = _both_ways(edges.where("a <> b"))
        large = stored(_with_least(both, 2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "components")
        # Small star: a node and its lower neighbours link to the least of them.
        small = _with_least(large, now[0])
        edges = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "components")
        before, now = now, _mark(edges)
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node")).unionByName(alone.select(F.col("a").alias("node"))).distinct()
    roots = roots.join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("root")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
