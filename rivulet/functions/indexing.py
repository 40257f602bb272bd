"""Position and running totals inside groups, without gathering a group in one task.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task; when one group holds a third of the data that task is the job.
Here one path serves every size, all of it in the JVM:

1. ``repartitionByRange(g, o)``: a group lies in consecutive range partitions,
   a hot one in many;
2. the rows are checkpointed with their partition number, which fixes it;
3. a window over (partition, g) numbers and sums the rows of a group inside
   one range partition, so no task holds more than a range partition of it;
4. rows per (partition, g) are counted and summed, a small aggregate, and a
   window over those counts gives what precedes each;
5. only groups continued from an earlier partition have something before
   them, at most one per partition; that table, bounded by the partition
   count, is broadcast to the rows.

Sums start anew in every (partition, group), so one group's values never
touch another's, and keys are compared by Spark itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import ensure_checkpoint_dir


def _sum_type(df: DataFrame, col: str) -> T.DataType:
    kind = df.schema[col].dataType
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def _numbered(df: DataFrame, group_cols: list[str], order_cols: list, value_cols: list[str],
              name: str, sum_names: list[str], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *group_cols, *order_cols)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    types = [_sum_type(df, c) for c in value_cols]
    filled = [F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) for c, t in zip(value_cols, types)]

    inside = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", (F.row_number().over(inside) - 1).cast("bigint").alias("_local"),
                          *[F.sum(v).over(upto).alias(f"_lsum{j}") for j, v in enumerate(filled)])

    counts = ranged.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s{j}") for j, v in enumerate(filled)])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_pid").alias("_opid"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)],
        F.sum("_n").over(before).alias("_off"),
        *[F.sum(f"_s{j}").over(before).alias(f"_soff{j}") for j in range(len(types))]).where("_off > 0")
    # Null-safe equality, so a null group key is a group like any other.
    cond = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(group_cols):
        cond = cond & local[c].eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(F.broadcast(starts), cond, "left")
    out = [F.col(c) for c in df.columns]
    out.append((F.col("_local") + F.coalesce("_off", F.lit(0))).cast("bigint").alias(name))
    for j, (sum_name, t) in enumerate(zip(sum_names, types)):
        out.append((F.col(f"_lsum{j}") + F.coalesce(f"_soff{j}", F.lit(0).cast(t))).cast(t).alias(sum_name))
    return joined.select(*out)


def index_within_groups(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                        name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name`` = 0-based position of the row in its group, ordered by ``order_cols``.

    ``order_cols`` must make the order total within a group (add a unique id
    as the last tie-break); rows that tie in all of them share one range
    partition.  ``group_cols`` may be empty: one global order.
    """
    return _numbered(df, group_cols, order_cols, [], name, [], num_partitions)


def running_total(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                  value_col: str | list[str], name: str | list[str], num_partitions: int | None = None,
                  index_name: str | None = None) -> DataFrame:
    """``df`` plus ``name`` = running sum of ``value_col`` (nulls count as 0) in ``order_cols`` order.

    Several value columns (and names) may be given at once.  With
    ``index_name`` the 0-based position is kept as well.
    """
    cols = [value_col] if isinstance(value_col, str) else list(value_col)
    names = [name] if isinstance(name, str) else list(name)
    if len(cols) != len(names):
        raise ValueError(f"{len(cols)} value columns but {len(names)} output names")
    out = _numbered(df, group_cols, order_cols, cols, index_name or "_idx", names, num_partitions)
    return out if index_name else out.drop("_idx")
