"""Series and sampling (T1-T5): the data side of the sequence model.

The reference trains an LSTM on one machine; what it computes from data --
indexed series, mini-batches, draws from a distribution, next-value
prediction -- is rebuilt here as Spark jobs.  The forecast is a different
model (per-series linear autoregression), not a copy of the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.indexing import index_within_groups, running_total
from rivulet.session import ensure_checkpoint_dir

# The reference marks every 10th mini-batch and retries a draw
# up to 1,000 times.
MARK_EVERY = 10
MAX_DRAWS = 1000
# Positions of a series that one window sees at once.
LAG_BLOCK = 100_000
# Probability sums and draws are compared as exact decimals.
SUM_TYPE = "decimal(38,20)"


# --------------------------------------------------------------------- T1
def index_series(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """(series..., idx, value, order...): 0-based position in each series, skew-safe."""
    idx = index_within_groups(df.select(*series, *order, value), series, order)
    return idx.select(*series, "idx", F.col(value).cast("double").alias("value"), *[c for c in order])


# --------------------------------------------------------------------- T2
def minibatches(indexed: DataFrame, batch_size: int = 1, epochs: int = 1) -> DataFrame:
    """Each item's mini-batch per epoch, and whether that batch is a sampling point (every 10th)."""
    batch_no = F.expr(f"idx div {int(batch_size)}")
    out = indexed.withColumn("batch_no", batch_no).withColumn(
        "is_mark", (F.col("batch_no") % MARK_EVERY) == (MARK_EVERY - 1))
    # epochs repeat the data: a generator, not a join
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(epochs) - 1))))


# --------------------------------------------------------------------- T3 / T4
def cumulative(dist: DataFrame, dist_id: str | None, index: str, prob: str) -> DataFrame:
    """(dist_id, pos, cum): 0-based position and running probability sum in index order, one row an outcome.

    ``dist_id=None``: the table is a single distribution.  The sums are exact
    decimals (20 places of a double, the scale of a decimal), so they are the
    same however the outcomes lie in partitions; a distribution of any size
    is summed piece by piece.  Indexes are unique in a distribution.  A null probability counts as 0; negative ones
    are an error, as the sums would then not ascend.
    """
    keys = [dist_id] if dist_id else []
    exact = F.col(prob) if isinstance(dist.schema[prob].dataType, (T.DecimalType, T.IntegralType)) else F.col(prob).cast(SUM_TYPE)
    checked = F.when(exact < 0, F.raise_error(F.lit("negative probability")).cast(SUM_TYPE)).otherwise(exact.cast(SUM_TYPE))
    rows = dist.select(*keys, F.col(index).alias("_i"), checked.alias("_p"))
    return running_total(rows, keys, ["_i"], "_p", "cum", index_name="pos").select(*keys, "pos", F.col("cum").cast(SUM_TYPE).alias("cum"))


def _totals(cums: DataFrame, dist_id: str | None) -> DataFrame:
    """(dist_id, _total): the last running sum of each distribution."""
    return cums.groupBy(*([dist_id] if dist_id else [])).agg(F.max("cum").alias("_total"))


def _attach_totals(draws: DataFrame, cums: DataFrame, dist_id: str | None) -> DataFrame:
    """Give each draw its distribution's total, one number a distribution; null if it is unknown."""
    totals = _totals(cums, dist_id)
    if dist_id is None:
        return draws.withColumn("_total", totals.select("_total").scalar())
    return draws.join(totals, dist_id, "left")


def _place(draws: DataFrame, cums: DataFrame, dist_id: str | None, draw: str, landing: str) -> DataFrame:
    """``draws`` plus ``sample_index``, the first position whose sum reaches the draw, where ``landing`` is true.

    Draws and running sums are range-partitioned together by (distribution,
    value), so the next outcome after a draw is mostly in its own partition: a
    running last value, from above, finds it.  For a draw behind the last
    outcome of its partition it is the first outcome of a later one; that
    table has at most one row per partition and distribution, and only
    distributions which span partitions are in it, so it is bounded by the
    number of partitions.  No task sees more than its range.
    """
    spark = draws.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(dist_id) if dist_id else F.lit(0)
    # Equal draws, however many, are told apart by a number, so that ranges can cut between them.
    asked = draws.select(key.alias("_k"), F.col(draw).cast(SUM_TYPE).alias("_v"), F.lit(0).alias("_kind"), F.monotonically_increasing_id().alias("_t"),
                         F.lit(None).cast("bigint").alias("_pos"), F.struct(*draws.columns).alias("_row"), F.col(landing).alias("_lands"))
    sums = cums.select(key.alias("_k"), F.col("cum").alias("_v"), F.lit(1).alias("_kind"), F.col("pos").alias("_t"), F.col("pos").alias("_pos"),
                       F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(None).cast("boolean").alias("_lands"))
    both = (asked.unionByName(sums).repartitionByRange(n, "_k", "_v", "_kind", "_t")
            .withColumn("_pid", F.spark_partition_id()).checkpoint())
    above = Window.partitionBy("_pid", "_k").orderBy(F.desc("_v"), F.desc("_kind"), F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_pos", ignorenulls=True).over(above)).where("_kind = 0")
    # Per partition and distribution the first outcome, and from these the first one of a later partition.
    firsts = both.groupBy("_pid", "_k").agg(F.min("_pos").alias("_first"))
    later = Window.partitionBy("_k").orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    far = firsts.select(F.col("_pid").alias("_fp"), F.col("_k").alias("_fk"), F.last("_first", ignorenulls=True).over(later).alias("_far")).where("_far IS NOT NULL")
    j = near.join(F.broadcast(far), (F.col("_pid") == F.col("_fp")) & F.col("_k").eqNullSafe(F.col("_fk")), "left")
    return j.select("_row.*", F.when(F.col("_lands"), F.coalesce("_near", "_far")).cast("int").alias("sample_index"))


def sample(draws: DataFrame, cums: DataFrame, dist_id: str | None, draw: str, strict: bool = True) -> DataFrame:
    """For each draw d, the first index whose running sum is >= d.

    A draw beyond the total and a draw from an unknown distribution are
    errors, or with ``strict=False`` have a null index and ``hit`` false.  A
    null draw has a null index and a null ``hit``.  Draws and distributions
    may be of any size (:func:`_place`).
    """
    j = _attach_totals(draws, cums, dist_id)
    known = F.col("_total").isNotNull()
    # NaN and draws too large for a decimal lie beyond every total.
    lands = F.coalesce(F.col(draw).try_cast(SUM_TYPE) <= F.col("_total"), F.lit(False))
    if strict:
        fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
        lands = (F.when(F.col(draw).isNull() | lands, lands)
                 .when(known, fail("draw exceeds the distribution's total")).otherwise(fail("draw from an unknown distribution")))
    j = j.withColumn("hit", F.when(F.col(draw).isNotNull(), lands)).drop("_total")
    j = j.withColumn("_v", F.col(draw).try_cast(SUM_TYPE))
    return _place(j, cums, dist_id, "_v", "hit").select(*draws.columns, "sample_index", "hit")


def _first_landing(draw_fn, lo: int, hi: int) -> Column:
    """(draw_no, draw) of the first draw in [lo, hi) that is at most the total, or null."""
    tries = F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)),
                        lambda j: F.struct(j.alias("draw_no"), draw_fn(j).alias("draw")))
    return F.get(F.filter(tries, lambda t: t["draw"].try_cast(SUM_TYPE) <= F.col("_total")), 0)


def sample_with_retry(keys: DataFrame, cums: DataFrame, dist_id: str | None, draw_fn,
                      first_round: int = 8, strict: bool = True) -> DataFrame:
    """T4: draws 0..999 per key until one lands inside the distribution; lowest draw number wins.

    ``draw_fn(draw_no)`` maps a draw-number Column to the draw.  Whether a
    draw lands depends on the distribution's total alone, so the winning draw
    is found in one projection: each key first tries ``first_round`` draws,
    and ``coalesce`` evaluates the others only for keys with no hit yet.  The
    winners are then placed as in :func:`sample`.  A key that never lands is
    an error, or with ``strict=False`` gets nulls; so does one of an unknown
    distribution.
    """
    j = _attach_totals(keys, cums, dist_id)
    lo = min(first_round, MAX_DRAWS)
    won = _first_landing(draw_fn, 0, lo)
    if lo < MAX_DRAWS:
        won = F.coalesce(won, _first_landing(draw_fn, lo, MAX_DRAWS))
    if strict:
        won = F.coalesce(won, F.raise_error(F.lit(f"no draw of {MAX_DRAWS} lands in the distribution")).cast("struct<draw_no:int,draw:double>"))
    drawn = j.withColumn("_w", won).select(*keys.columns, F.col("_w.draw_no").alias("draw_no"), F.col("_w.draw").alias("draw"))
    drawn = drawn.withColumn("_v", F.col("draw").try_cast(SUM_TYPE)).withColumn("_lands", F.col("draw").isNotNull())
    return _place(drawn, cums, dist_id, "_v", "_lands").select(*keys.columns, "draw_no", "draw", "sample_index")


# --------------------------------------------------------------------- T5
def ar1_forecast(df: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Per series: fit y[t] = a + b * y[t-1] and predict the value after the last.

    Positions come from the range-partitioned index.  The previous value is
    ``lag`` inside blocks of consecutive positions; the last row of a block is
    also the first that the next one sees, so no pair is lost and no window
    holds more than a block.  The fit is a plain aggregate with partial
    aggregation.  A series of one value has no pair, so its slope, intercept
    and forecast are null.
    """
    idx = index_series(df, series, order, value)
    block = F.expr(f"idx div {LAG_BLOCK}")
    rows = idx.select(*series, "idx", F.col("value").alias("y"), F.explode(F.when(
        F.col("idx") % LAG_BLOCK == LAG_BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"))
    prev = F.lag("y").over(Window.partitionBy(*series, "_block").orderBy("idx"))
    mine = rows.withColumn("y_prev", prev).where(F.col("_block") == F.expr(f"idx div {LAG_BLOCK}"))
    paired = F.col("idx") > 0
    fit = mine.groupBy(*series).agg(
        F.count(F.when(paired, F.lit(1))).alias("n_pairs"),
        F.regr_slope(F.when(paired, F.col("y")), F.col("y_prev")).alias("slope"),
        F.regr_intercept(F.when(paired, F.col("y")), F.col("y_prev")).alias("intercept"),
        F.max_by("y", "idx").alias("last_value"))
    return fit.withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("last_value"))
