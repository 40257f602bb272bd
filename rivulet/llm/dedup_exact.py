"""Exact de-duplication by salted combining (DataFrame operations only).

Texts are equal when they are identical after deleting white space
``[\\x20\\x09-\\x0D]``.  Every combining stage groups by the whole
normalised text, not only by its digest:

1. local: Spark's partial aggregation merges equal texts inside a map task;
2. salted: the rows of a hot digest are dealt over ``salts`` groups;
3. global: the few salt winners of a hot digest are merged.

Only digests that hold more than a thousandth of all rows are salted; there
are at most a thousand of them, so that list is broadcast.  Texts cross the
network once; rows find their group again by digest, in a second, narrow join.
Two different texts under one digest are told apart there by the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import WHITE, read_table, stored, with_row

HOT_SHARE = 1000
SALTS = 32


def _normal(text):
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``_row, doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id (null last), then the first row; exactly
    one row of a group has ``kept``.  Null text counts as empty, and all empty
    texts are one group.  An empty table gives an empty result.  Other columns
    of ``docs`` are not read.
    """
    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.select("_row", "doc_id", _normal(F.col("text")).alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = rows.withColumn("digest", F.sha2(F.col("t").cast("binary"), 256))
    digests = stored(rows.select("_row", "doc_id", "n", "digest"), "exact-digests")

    total = digests.count()
    hot = digests.groupBy("digest").count().where(F.col("count") * HOT_SHARE > total).select("digest", F.lit(salts).alias("of"))
    better = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "_row").alias("best")
    salted = (
        rows.join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("of").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), F.col("of")).cast("int")))
        .withColumn("best", better)
        .groupBy("digest", "salt", "t")
        .agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("size"), F.max(F.col("of").isNotNull()).alias("is_hot"))
    )
    done = salted.where(~F.col("is_hot")).select("digest", "t", "best", "size")
    joined = salted.where("is_hot").groupBy("digest", "t").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    winners = done.unionByName(joined)
    found = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("best").alias("best"), F.sum("size").alias("size"))
    found = stored(found.where("size > 1").select("digest", "texts", "size", F.col("best.doc_id").alias("keep_id"), F.col("best._row").alias("keep_row")), "exact-groups")

    named = digests.join(found, "digest", "left")
    out = named.where("texts IS NULL OR texts = 1").select(
        "_row", "doc_id",
        F.when(F.col("texts").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    clash = found.where("texts > 1").select("digest")
    if clash.isEmpty():
        return out
    # Different texts under one digest: find the group by the whole text.
    apart = rows.join(clash, "digest", "left_semi").join(winners.select("digest", "t", "best", "size"), ["digest", "t"])
    return out.unionByName(apart.select(
        "_row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.col("best._row") == F.col("_row")).alias("kept"), F.col("digest").alias("text_sha256"),
    ))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).drop("_row")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM t
"""
