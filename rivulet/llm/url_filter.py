"""URL filtering against dated lists: an as-of join (DataFrame operations only).

A list is a log of dated entries ``(list_name, pattern, action, since)`` where
``pattern`` is a host, a parent domain, or either with a path prefix, and
``action`` is ``block``, ``allow`` or ``remove`` (the pattern leaves the list).
Consecutive entries of a pattern become validity intervals ``[since, until)``.
Every capture is expanded to its own keys (each parent domain, alone and with
each path prefix: a number bounded by the URL's own depth); those that some
list names go into the as-of join.  There the captures and the intervals of a
list's pattern are merged in the order of time, month by month, and each
capture takes the last interval that began before it, if that still holds: a
row per capture, however many entries the pattern has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import fresh, read_table, stored, with_row

#: A pattern that more than this share of the asked keys name is dealt over salts; there are at most so many, so they are broadcast.
HOT_SHARE = 1000


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, pattern, action, since, until``: one row per entry that is in force for some time.

    Of entries of one list and pattern on one date the last by action name
    counts (remove over block over allow).  Entries with a null pattern, date
    or action are ignored; repeated entries collapse.  ``until`` is null for an
    entry still in force.  The entries of one pattern are ordered month by
    month, so a pattern with very many of them is spread over tasks.
    """
    e = entries.select("list_name", F.lower("pattern").alias("pattern"), "action", "since")
    e = e.where("pattern IS NOT NULL AND since IS NOT NULL AND action IS NOT NULL")
    e = e.groupBy("list_name", "pattern", "since").agg(F.max("action").alias("action"))
    e = e.withColumn("month", F.date_trunc("month", "since"))
    key = ["list_name", "pattern", "month"]
    inside = F.lead("since").over(Window.partitionBy(*key).orderBy("since"))
    firsts = e.groupBy(*key).agg(F.min("since").alias("first"))
    later = F.lead("first").over(Window.partitionBy("list_name", "pattern").orderBy("month"))
    months = firsts.select(*[F.col(c).alias(f"of_{c}") for c in key], later.alias("later"))
    spans = e.withColumn("inside", inside).join(months, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key])
    spans = spans.select("list_name", "pattern", "since", "action", F.coalesce("inside", "later").alias("until"))
    return spans.where("action <> 'remove'")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.rtrim(rest, F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """The patterns that can name a URL, most specific first is not implied."""
    labels = F.split(host, r"\.")
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.concat(F.array(F.lit("")), F.when(F.size(parts) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lower(p))))))


def as_of(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """``r, list_name, pattern, action`` of the interval in force, if any, for each row of stored ``asked(r, at, list_name, pattern)``.

    Captures, intervals and what was in force when a month began are merged
    by time within (list, pattern, month).  A pattern that very many captures
    name is dealt over salts as its measured share asks for, and its intervals
    are repeated for each; no capture meets more than one interval.
    """
    key = ["list_name", "pattern"]
    month = lambda at: F.date_trunc("month", at)
    asked = asked.withColumn("month", month(F.col("at")))
    valid = valid.select(*key, F.col("since").cast("timestamp").alias("since"), F.struct("action", F.col("until").cast("timestamp").alias("until")).alias("state"))
    valid = valid.withColumn("month", month(F.col("since")))
    total = asked.count()
    hot = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total)
    hot = hot.select(F.col("list_name").alias("hot_list"), F.col("pattern").alias("hot_pattern"), (F.ceil(F.col("n") * HOT_SHARE / total / 4) + 1).cast("int").alias("of"))

    def with_salts(df: DataFrame) -> DataFrame:
        same = F.col("list_name").eqNullSafe(F.col("hot_list")) & (F.col("pattern") == F.col("hot_pattern"))
        return df.join(F.broadcast(hot), same, "left").withColumn("of", F.coalesce("of", F.lit(1))).drop("hot_list", "hot_pattern")

    # The last interval of each month, carried on to the months in which captures ask.
    heads = valid.groupBy(*key, "month").agg(F.max(F.struct("since", "state")).alias("last")).select(*key, "month", F.col("last.state").alias("state"))
    months = heads.unionByName(asked.select(*key, "month").distinct(), allowMissingColumns=True)
    months = months.groupBy(*key, "month").agg(F.first("state", ignorenulls=True).alias("state"))
    earlier = Window.partitionBy(*key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = months.select(*key, "month", F.col("month").alias("at"), F.lit(0).alias("kind"), F.last("state", ignorenulls=True).over(earlier).alias("state")).where("state IS NOT NULL")
    began = valid.select(*key, "month", F.col("since").alias("at"), F.lit(1).alias("kind"), "state")
    lists = with_salts(carried.unionByName(began)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    captures = with_salts(asked.select("r", *key, "month", "at", F.lit(2).alias("kind"))).withColumn("salt", F.pmod(F.xxhash64("r"), F.col("of")).cast("int")).drop("of")
    merged = lists.unionByName(captures, allowMissingColumns=True)
    upto = Window.partitionBy(*key, "month", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("state", F.last("state", ignorenulls=True).over(upto)).where("kind = 2 AND state IS NOT NULL")
    return found.where("state.until IS NULL OR at < state.until").select("r", *key, F.col("state.action").alias("action"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host, verdict, matched_pattern, matched_list, n_active``.

    The longest matching pattern decides; at equal length ``block`` wins over
    ``allow``, then the smallest list name.  ``verdict`` is ``block`` or
    ``allow``; no entry in force, a null or malformed URL or a null fetch time
    give ``allow`` with null pattern.  ``n_active`` counts the matching
    entries in force.  Every input row gives one output row, repeated rows
    too; an empty list allows everything.  An output column whose name the input has gets
    leading underscores.
    """
    row = fresh(captures, "_row")
    caps = with_row(captures, row)
    named = {c: fresh(captures, c) for c in ("host", "verdict", "matched_pattern", "matched_list", "n_active")}
    asked = caps.select(F.col(row).alias("r"), F.col(time_col).alias("at"), host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p"))
    asked = asked.where("at IS NOT NULL AND h IS NOT NULL").select("r", "at", F.explode(keys_of(F.col("h"), F.col("p"))).alias("pattern"))
    valid = intervals(entries)
    # Only keys that a list names go on; a domain that a third of all captures have is split by adaptive execution.
    asked = asked.withColumn("at", F.col("at").cast("timestamp")).join(valid.select("pattern", "list_name").distinct(), "pattern")
    hits = as_of(stored(asked, "url-asked"), valid)
    rank = F.struct((-F.length("pattern")).alias("l"), (F.col("action") != "block").alias("b"), "list_name", "pattern")
    best = hits.groupBy("r").agg(F.min(rank).alias("m"), F.count(F.lit(1)).alias("n"))
    best = best.withColumnRenamed("r", row)
    out = caps.join(best, row, "left")
    return out.select(
        *[c for c in captures.columns],
        host_of(F.col(url_col)).alias(named["host"]),
        F.when(F.col("m").isNotNull() & ~F.col("m.b"), "block").otherwise("allow").alias(named["verdict"]),
        F.col("m.pattern").alias(named["matched_pattern"]),
        F.col("m.list_name").alias(named["matched_list"]),
        F.coalesce("n", F.lit(0)).cast("long").alias(named["n_active"]),
    )


# The given tables hold no list and no fetch time: both are derived from pages.
# A page is fetched (page_id mod 365) days into 2024.  Every host with a page
# whose id is 0, 1 or 2 mod 7 is listed by such a page, on that page's date.
_FETCHED = "date_add(DATE '2024-01-01', CAST(page_id % 365 AS INT))"


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(_FETCHED))
    listed = captures.where("page_id % 7 <= 2").select(
        F.when(F.col("page_id") % 2 == 0, "ads").otherwise("adult").alias("list_name"),
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", ""))
        .when(F.col("page_id") % 5 == 1, F.concat(host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^(/[^/]+)", 1)))
        .otherwise(host_of(F.col("url"))).alias("pattern"),
        F.when(F.col("page_id") % 7 == 0, "block").when(F.col("page_id") % 7 == 1, "remove").otherwise("allow").alias("action"),
        F.col("fetched").alias("since"),
    )
    return filter_urls(captures, listed)


OP9_SQL = r"""
WITH caps AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS DATE) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), entries AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'ads' ELSE 'adult' END AS list_name,
         CASE WHEN page_id % 5 = 0 THEN regexp_replace(host, '^(www|m|blog)\.', '')
              WHEN page_id % 5 = 1 THEN host || lower(regexp_extract(path, '^(/[^/]+)', 1)) ELSE host END AS pattern,
         max(CASE WHEN page_id % 7 = 0 THEN 'block' WHEN page_id % 7 = 1 THEN 'remove' ELSE 'allow' END) AS action,
         fetched AS since
  FROM caps WHERE page_id % 7 <= 2 GROUP BY ALL
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY list_name, pattern ORDER BY since) AS until FROM entries
), keys AS (
  SELECT DISTINCT page_id, fetched, array_to_string(labels[i:], '.') ||
         CASE WHEN j = 0 THEN '' ELSE lower('/' || array_to_string(parts[:j], '/')) END AS pattern
  FROM (SELECT page_id, fetched, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM caps),
       LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS i), LATERAL (SELECT unnest(range(0, len(parts) + 1)) AS j)
), hits AS (
  SELECT k.page_id, s.pattern, s.list_name, s.action,
         row_number() OVER (PARTITION BY k.page_id ORDER BY length(s.pattern) DESC, s.action <> 'block', s.list_name, s.pattern) AS r,
         count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keys k JOIN spans s ON k.pattern = s.pattern AND s.action <> 'remove' AND s.since <= k.fetched AND (s.until IS NULL OR k.fetched < s.until)
)
SELECT c.page_id, c.url, c.fetched, c.host,
       CASE WHEN h.action = 'block' THEN 'block' ELSE 'allow' END AS verdict,
       h.pattern AS matched_pattern, h.list_name AS matched_list, coalesce(h.n, 0) AS n_active
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""
