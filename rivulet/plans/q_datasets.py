"""Registered queries for dataset idioms (D1-D8) and series/sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators import datasets as D
from rivulet.operators import series as S
from rivulet.plans.registry import make_registry
from rivulet.session import table, work_dir
from rivulet.sources.append_log import AppendLog

QUERIES, ORACLES, register = make_registry()

# Fixed values of the fixtures: accumulation batches, list piece size,
# mini-batch size and epochs, the draw formula's multipliers
# the range of draws among lines, the batches of the append log.
ACC_BATCHES = 144
PIECE_ROWS = 1000
MINIBATCH_SIZE = 1
EPOCHS = 2
DRAW_MUL, RETRY_MUL = 37, 53
DRAW_RANGE = 100_000
LOG_BATCHES = 10


@register("word_count", """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names (fixture I) counted."""
    return D.word_count(table(spark, sf_dir, "part"), "p_name", " ")


@register("chunk_group_list", """
SELECT event_id // 100 AS chunk, event_id % 2 AS k, list(event_id ORDER BY event_id) AS "values"
FROM events GROUP BY 1, 2""")
def chunk_group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key x % 2, grouped to lists inside chunks of 100 ids (fixture K)."""
    e = table(spark, sf_dir, "events")
    return D.chunk_group_list(e, F.expr("event_id div 100"), F.col("event_id") % 2, "event_id")


@register("group_list", f"""
SELECT event_type AS k, (rn - 1) // {PIECE_ROWS} AS piece, list(event_id ORDER BY event_id) AS "values"
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
      FROM events)
GROUP BY 1, 2""")
def group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids listed per event type, in sorted pieces of at most 1,000."""
    return D.group_list(table(spark, sf_dir, "events"), F.col("event_type"), "event_id", PIECE_ROWS)


@register("union_all_bag", """
SELECT p_partkey AS x FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey FROM part WHERE p_partkey * 2 > 18
UNION ALL SELECT p_partkey * 2 FROM part""")
def union_all_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, filter, map -- then a bag union keeping duplicates."""
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"))
    return D.union_all([x.where(F.col("x") % 3 == 0), x.where(F.col("x") * 2 > 18),
                        x.select((F.col("x") * 2).alias("x"))])


@register("map_elements", "SELECT p_partkey AS id, p_partkey - 1 AS y FROM part")
def map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passed function x -> x - 1 applied to every element."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return D.map_elements(p, "id", lambda x: x - 1, "y")


@register("accumulating_counts", f"""
SELECT batch, n_rows, CAST(sum(n_rows) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_rows
FROM (SELECT l_orderkey % {ACC_BATCHES} AS batch, count(*) AS n_rows FROM lineitem GROUP BY 1)""")
def accumulating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem arriving in 144 batches; table size after each append."""
    li = table(spark, sf_dir, "lineitem")
    return D.accumulating_counts(li, F.col("l_orderkey") % ACC_BATCHES)


@register("append_log", f"""
SELECT CAST(l_orderkey % {LOG_BATCHES} AS BIGINT) AS batch, CASE WHEN l_orderkey % {LOG_BATCHES} < 9 THEN 0 ELSE 9 END AS first_batch,
       count(*) AS n_rows, round(sum(l_quantity), 4) AS sum_qty
FROM lineitem GROUP BY 1, 2""")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem appended in ten batches; the first nine have been merged, three and three, into one segment."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % LOG_BATCHES).alias("batch"), "l_quantity")
    log = AppendLog(spark, work_dir(spark, "append-log"), "batch bigint, l_quantity double", fanout=3)
    for b in range(LOG_BATCHES):
        log.append(li.where(F.col("batch") == b), b)
    starts = F.create_map(*[F.lit(x) for s in log.manifest() for x in (s.segment, s.first)])
    segment = F.regexp_extract(F.col("_metadata.file_path"), "/segment=([^/]*)/", 1)
    rows = log.read().select("batch", "l_quantity", F.element_at(starts, segment).cast("int").alias("first_batch"))
    return rows.groupBy("batch", "first_batch").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


_SERIES_SQL = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
       value, ts, event_id FROM events"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_series(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@register("series_index", _SERIES_SQL)
def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events.value per user as a 0-based indexed series (fixture G)."""
    return _series(spark, sf_dir)


@register("series_minibatches", f"""
SELECT user_id, event_id, idx, idx // {MINIBATCH_SIZE} AS batch_no,
       (idx // {MINIBATCH_SIZE}) % 10 = 9 AS is_mark, CAST(e.epoch AS INTEGER) AS epoch
FROM ({_SERIES_SQL}) s, generate_series(0, {EPOCHS - 1}) AS e(epoch)""")
def series_minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mini-batches of one item, every 10th marked, repeated for 2 epochs."""
    mbs = S.minibatches(_series(spark, sf_dir), MINIBATCH_SIZE, EPOCHS)
    return mbs.select("user_id", "event_id", "idx", "batch_no", "is_mark", "epoch")


def _type_shares(spark: SparkSession, sf_dir: str, exclude: str | None = None) -> DataFrame:
    """Fixture H: share of each event type, index = position of the type name."""
    e = table(spark, sf_dir, "events")
    total = e.agg(F.count(F.lit(1)).alias("t")).scalar()
    shares = e.groupBy("event_type").agg((F.count(F.lit(1)) / total).alias("p"))
    if exclude:
        shares = shares.where(F.col("event_type") != exclude)
    # one row per event type: the ordered window sees only that
    return shares.withColumn("i", F.row_number().over(Window.orderBy("event_type")) - 1)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


_SHARES_SQL = """shares AS (
  SELECT event_type, count(*) / (SELECT count(*) FROM events) AS p FROM events GROUP BY event_type{excl}),
cums AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i,
                sum(p) OVER (ORDER BY event_type ROWS UNBOUNDED PRECEDING) AS cum FROM shares)"""


@register("distribution_sample", f"""
WITH {_SHARES_SQL.format(excl='')},
draws AS (SELECT DISTINCT user_id, ((user_id * {DRAW_MUL}) % 100) / 100.0 AS draw FROM events)
SELECT d.user_id, d.draw, CAST((SELECT count(*) FROM cums c WHERE c.cum < d.draw) AS INTEGER) AS sample_index
FROM draws d""")
def distribution_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw per user from the event-type distribution (first running sum >= draw)."""
    cums = S.cumulative(_type_shares(spark, sf_dir), None, "i", "p")
    draws = _users(spark, sf_dir).withColumn("draw", ((F.col("user_id") * DRAW_MUL) % 100) / 100.0)
    return S.sample(draws, cums, None, "draw").select("user_id", "draw", "sample_index")


@register("distribution_sample_retry", f"""
WITH {_SHARES_SQL.format(excl=" HAVING event_type <> 'view'")},
users AS (SELECT DISTINCT user_id FROM events),
tries AS (SELECT user_id, CAST(g.j AS INTEGER) AS draw_no,
                 ((user_id * {DRAW_MUL} + g.j * {RETRY_MUL}) % 100) / 100.0 AS draw
          FROM users, generate_series(0, 999) AS g(j)),
landed AS (SELECT * FROM tries WHERE draw <= (SELECT max(cum) FROM cums)),
firsts AS (SELECT user_id, min(draw_no) AS draw_no FROM landed GROUP BY user_id)
SELECT user_id, draw_no, draw, CAST((SELECT count(*) FROM cums c WHERE c.cum < l.draw) AS INTEGER) AS sample_index
FROM landed l JOIN firsts USING (user_id, draw_no)""")
def distribution_sample_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the distribution without 'view' sums below 1; draws retry until one lands."""
    cums = S.cumulative(_type_shares(spark, sf_dir, exclude="view"), None, "i", "p")
    draw = lambda j: ((F.col("user_id") * DRAW_MUL + j * RETRY_MUL) % 100) / 100.0
    out = S.sample_with_retry(_users(spark, sf_dir), cums, None, draw)
    return out.select("user_id", "draw_no", "draw", "sample_index")


@register("distribution_sample_lines", f"""
WITH outcomes AS (SELECT l_returnflag, l_orderkey AS i, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2),
sums AS (
  SELECT l_returnflag, row_number() OVER o - 1 AS pos, sum(w) OVER o AS cum FROM outcomes
  WINDOW o AS (PARTITION BY l_returnflag ORDER BY i ROWS UNBOUNDED PRECEDING)),
draws AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_returnflag,
                 (o_orderkey * {DRAW_MUL}) % {DRAW_RANGE} + 0.5 AS draw FROM orders)
SELECT d.o_orderkey, d.l_returnflag, CAST(d.draw AS DOUBLE) AS draw, CAST(s.pos AS INTEGER) AS sample_index, s.pos IS NOT NULL AS hit
FROM draws d ASOF LEFT JOIN sums s ON d.l_returnflag = s.l_returnflag AND s.cum >= d.draw""")
def distribution_sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per return flag the orders of its lines are outcomes, weighted by quantity; one draw an order, null beyond the total."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_orderkey").alias("i")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("w"))
    o = F.col("o_orderkey")
    draws = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (o % 3 + 1).cast("int")).alias("l_returnflag"),
        ((o * DRAW_MUL) % DRAW_RANGE + 0.5).cast("double").alias("draw"))
    cums = S.cumulative(lines, "l_returnflag", "i", "w")
    return S.sample(draws, cums, "l_returnflag", "draw", strict=False)


@register("ar1_forecast", f"""
WITH s AS ({_SERIES_SQL}),
p AS (SELECT a.user_id, a.value AS y, b.value AS y_prev FROM s a JOIN s b
      ON a.user_id = b.user_id AND a.idx = b.idx + 1),
fit AS (SELECT user_id, count(*) AS n_pairs, regr_slope(y, y_prev) AS slope,
               regr_intercept(y, y_prev) AS intercept FROM p GROUP BY user_id),
last AS (SELECT user_id, arg_max(value, idx) AS last_value FROM s GROUP BY user_id)
SELECT l.user_id, coalesce(f.n_pairs, 0) AS n_pairs, round(f.slope, 6) AS slope, round(f.intercept, 6) AS intercept,
       l.last_value, round(f.intercept + f.slope * l.last_value, 6) AS forecast
FROM last l LEFT JOIN fit f ON f.user_id = l.user_id""")
def ar1_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: per-user AR(1) fit on the indexed series and the next-value forecast."""
    f = S.ar1_forecast(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return f.select("user_id", "n_pairs", F.round("slope", 6).alias("slope"),
                    F.round("intercept", 6).alias("intercept"), "last_value",
                    F.round("forecast", 6).alias("forecast"))
