import datetime as dt
import random

from rivulet.llm.url_filter import filter_urls, intervals, op9_url_filter

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute(url, at, entries):
    """Longest pattern in force at ``at``; block before allow, then the list's name."""
    if url is None or at is None or "://" not in url:
        return "allow", None, None, 0
    rest = url.split("://", 1)[1]
    host, _, path = rest.split("?")[0].split("#")[0].partition("/")
    host = host.split("@")[-1].split(":")[0].lower()
    if not host:
        return "allow", None, None, 0
    parts, labels = [p for p in path.split("/") if p], host.split(".")
    keys = {".".join(labels[i:]) + "".join("/" + p.lower() for p in parts[:j]) for i in range(len(labels)) for j in range(len(parts) + 1)}
    state = {}
    for name, pattern, action, since in sorted((e for e in entries if None not in e[1:]), key=lambda e: (e[3], e[2])):
        if since <= at:
            state[name, pattern.lower()] = action
    on = [(-len(p), a != "block", n, p) for (n, p), a in state.items() if a != "remove" and p in keys]
    if not on:
        return "allow", None, None, 0
    _, allowed, name, pattern = min(on)
    return "allow" if allowed else "block", pattern, name, len(on)


def test_matches_brute_force(spark, store):
    rng = random.Random(8)
    hosts = ["a.com", "www.a.com", "x.y.b.org", "b.org", "c.net"]
    entries = [
        (rng.choice(["l1", "l2"]), rng.choice([*hosts, "com", "org", "a.com/p", "B.org/p/q", "y.b.org"]), rng.choice(["block", "allow", "remove"]), DAY(rng.randrange(40)))
        for _ in range(80)
    ] + [("l1", None, "block", DAY(0)), ("l1", "a.com", None, DAY(0)), ("l1", "a.com", "block", None)]
    captures = [
        (i, f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{rng.choice([h, h.upper()])}{rng.choice(['', ':8080'])}{rng.choice(['', '/', '/p', '/P/q', '/p//q/r.html'])}{rng.choice(['', '?a=/b', '#f'])}", DAY(rng.randrange(45)))
        for i in range(400)
        for h in [rng.choice(hosts + ["a.com"] * 4)]
    ] + [(900, None, DAY(3)), (901, "", DAY(3)), (902, "no url", DAY(3)), (903, "http://", DAY(3)), (904, "http://a.com/", None), (905, "http://a.com/", DAY(20)), (905, "http://a.com/", DAY(20))]
    table = store(captures, "page_id long, url string, fetched date").selectExpr("*", "'mine' AS host", "1 AS salt", "2 AS _row")
    got = filter_urls(table, store(entries, "list_name string, pattern string, action string, since date")).collect()
    assert len(got) == len(captures)
    for r in got:
        assert (r.verdict, r.matched_pattern, r.matched_list, r.n_active) == brute(r.url, r.fetched, entries), r
        assert r.host == "mine" and r["_row"] == 2


def test_intervals(store):
    log = [("l", "p", "block", DAY(1)), ("l", "p", "block", DAY(1)), ("l", "p", "remove", DAY(5)), ("l", "p", "allow", DAY(9))]
    got = {(r.action, r.since, r.until) for r in intervals(store(log, "list_name string, pattern string, action string, since date")).collect()}
    assert got == {("block", DAY(1), DAY(5)), ("allow", DAY(9), None)}


def test_intervals_across_months_and_unnamed_lists(store):
    log = [(name, "p", a, DAY(n)) for name in ("l", None) for n, a in ((3, "block"), (20, "allow"), (75, "block"), (200, "remove"), (201, "block"))]
    got = sorted((str(r.list_name), r.action, r.since, str(r.until)) for r in intervals(store(log, "list_name string, pattern string, action string, since date")).collect())
    one = [("allow", DAY(20), str(DAY(75))), ("block", DAY(3), str(DAY(20))), ("block", DAY(75), str(DAY(200))), ("block", DAY(201), "None")]
    assert got == sorted([("None", *x) for x in one] + [("l", *x) for x in one])


def test_no_list_and_no_captures(store):
    nothing = store([], "list_name string, pattern string, action string, since date")
    some = store([(1, "http://a.com/", DAY(1))], "page_id long, url string, fetched date")
    assert [r.verdict for r in filter_urls(some, nothing).collect()] == ["allow"]
    assert filter_urls(some.where("page_id > 1"), nothing).collect() == []


def test_plan_has_no_python(spark, sf_dir):
    plan = op9_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_matches_its_sql(spark, sf_dir):
    import duckdb

    from rivulet.llm.url_filter import OP9_SQL

    pages = duckdb.sql(f"SELECT * FROM '{sf_dir}/pages.parquet'")  # noqa: F841
    want = duckdb.sql(OP9_SQL)
    got = op9_url_filter(spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_a_pattern_with_many_entries_and_captures_costs_linear_rows(spark):
    """10^4 entries and 10^5 captures of one pattern: every capture meets one interval."""
    from pyspark.sql import functions as F

    from rivulet.llm.common import stored
    from rivulet.llm.url_filter import as_of

    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 997)
    entries = spark.range(10_000).select(F.lit("l").alias("list_name"), F.lit("a.com").alias("pattern"), F.when(F.col("id") % 3 == 0, "remove").when(F.col("id") % 3 == 1, "block").otherwise("allow").alias("action"), at.alias("since"))
    asked = spark.range(100_000).select(F.col("id").alias("r"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 9_970_000).alias("at"), F.lit("l").alias("list_name"), F.lit("a.com").alias("pattern"))
    asked = stored(asked, "asked")
    got = as_of(asked, intervals(entries))
    rows = {r.r: r.action for r in got.collect()}
    want = {}
    for i in range(100_000):
        k = (i * 7919) % 9_970_000 // 997
        if k % 3:
            want[i] = "block" if k % 3 == 1 else "allow"
    assert rows == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
