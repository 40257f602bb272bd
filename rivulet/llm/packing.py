"""Sequence packing by optimal length buckets.

The global histogram of token lengths is aggregated in Spark.  Dynamic
programming over it chooses the bucket boundaries with the least padding, and
batches of at most ``token_budget`` padded tokens form inside each bucket.

The histogram holds every distinct length, so boundaries are optimal and each
is the length of a document.  ``n`` distinct lengths take ``n * n / 2`` tokens
at least, so 10^13 tokens have at most some millions of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from rivulet.llm.common import fresh, read_table, stored, with_row

PRECISION = 8
SHARDS = 1024
#: Options of the dynamic programming that are compared in one vector step.
STEP = 1 << 22


def word_count(text: Column) -> Column:
    """Runs of non-white characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Tokens of a text under the tokenizer file at ``path`` (JSON of the tokenizers library); null has none.

    The driver reads the file and ships it, so the executors need no copy.
    """
    with open(path, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shipped.value)
        tokenizer.encode_special_tokens = True
        out = []
        for at in range(0, len(texts), 256):
            batch = [t.as_py() or "" for t in texts[at : at + 256]]
            out += [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
        return pa.array(out, pa.int64())

    return count(text)


def bin_of(length: Column) -> Column:
    """The least number with ``PRECISION`` significant bits that is not below ``length``, for coarse histograms (``pack`` uses none)."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - (PRECISION - 1))).cast("long")
    return ((length + step - 1) / step).cast("long") * step


def best_boundaries(edges: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padded total.

    ``edges`` ascend; a document in bin ``i`` is padded to the bound of its
    bucket.  The cost is Monge, so the best splits ascend with the end: every
    other end is searched between the splits of its neighbours, O(n log n) a
    bucket in vector steps.  Of equal choices the leftmost split wins.
    """
    n = len(edges)
    if not n:
        return []
    edges = np.asarray(edges, float)
    total = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        new, came, step = np.zeros(n + 1), np.zeros(n + 1, np.int32), 1 << (n.bit_length() - 1)
        while step:
            ends = np.arange(step, n + 1, 2 * step)
            low = came[ends - step].astype(np.int64)
            high = np.minimum(np.where(ends + step <= n, came[np.minimum(ends + step, n)], n), ends - 1)
            size = high - low + 1
            piece, at = np.cumsum(size) // STEP, 0
            while at < len(ends):
                upto = int(np.searchsorted(piece, piece[at], "right"))
                j, k = ends[at:upto], size[at:upto]
                first = np.cumsum(k) - k
                i = np.arange(k.sum()) + np.repeat(low[at:upto] - first, k)
                end = np.repeat(j, k)
                options = cost[i] + (total[end] - total[i]) * edges[end - 1]
                new[j] = np.minimum.reduceat(options, first)
                best = np.flatnonzero(options == np.repeat(new[j], k))
                came[j] = i[best[np.searchsorted(best, first)]]
                at = upto
            step //= 2
        back.append(came)
        cost = new
    bounds, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        bounds.append(int(edges[j - 1]))
        j = int(came[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, token_budget: int = 65536, length: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, bucket_len, batch, position, padding``.

    ``length`` is the token count of a row (see ``token_count``); by default
    its white-space separated words.  A document of no tokens (null or empty text) is in
    bucket 0 with the shortest ones.  A bucket longer than the budget has one
    document a batch, so no text is cut or dropped.  Batches are numbered from
    0 in each bucket, in the order (hash of id and row mod 1024, doc_id, row);
    ids may be of any type, null ids come last in their shard, repeated ids
    are placed once each.  All batches of a bucket but its last are full.  An empty table
    gives an empty result.  Other columns of ``docs`` are not read.
    """
    n_tokens = word_count(F.col(text_col)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    row = fresh(docs, "_row")
    rows = with_row(docs, row).select(F.col(id_col).alias("doc_id"), n_tokens.alias("n_tokens"), F.col(row).alias("_row"))
    rows = stored(rows, "pack-lengths")

    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    bounds = best_boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    bucket, bound = F.lit(max(len(bounds) - 1, 0)), F.lit(bounds[-1] if bounds else 0)
    for k, upto in reversed(list(enumerate(bounds[:-1]))):
        inside = F.col("n_tokens") <= upto
        bucket, bound = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(upto)).otherwise(bound)

    rows = rows.select(
        "_row", "doc_id", "n_tokens", bucket.cast("int").alias("bucket"), bound.cast("long").alias("bucket_len"),
        F.pmod(F.xxhash64("doc_id", "_row"), F.lit(SHARDS)).cast("int").alias("shard"),
    )
    # Shards keep each window small; the (bucket, shard) counts are at most buckets x 1024 rows.
    sizes = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("bucket", "shard").orderBy(F.col("doc_id").asc_nulls_last(), "_row")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    placed = rows.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(starts), ["bucket", "shard"])
    placed = placed.withColumn("at", F.col("at") + F.col("start"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(F.col("at") / per_batch).cast("long").alias("batch"), F.pmod("at", per_batch).cast("long").alias("position"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
