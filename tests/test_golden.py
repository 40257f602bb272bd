"""Golden cases taken from the reference's own tests."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import datasets as D
from rivulet.operators import rules as R
from rivulet.operators import series as S


def test_word_count_golden(spark):
    df = spark.createDataFrame([("ds,ds,ds,sd,sc",)], "line string")
    got = {r["word"]: r["n"] for r in D.word_count(df, "line", ",").collect()}
    assert got == {"ds": 3, "sd": 1, "sc": 1}


def test_map_elements_golden(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 6, 8, 7, 9]], "x long")
    jvm = [r["y"] for r in D.map_elements(df, "x", lambda c: c - 1).orderBy(F.monotonically_increasing_id()).collect()]
    assert jvm == [0, 1, 2, 3, 4, 5, 7, 6, 8]
    # a pandas function takes the Arrow path
    py = D.map_elements(df, "x", lambda s: s.map(lambda v: v - 1), pandas=True).collect()
    assert sorted(r["y"] for r in py) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    # an error of the function is the caller's to see
    with pytest.raises(ZeroDivisionError):
        D.map_elements(df, "x", lambda c: 1 / 0)
    with pytest.raises(TypeError, match="pandas=True"):
        D.map_elements(df, "x", lambda c: 5)


def test_union_all_bag_golden(spark):
    x = spark.range(1, 11).select(F.col("id").alias("x"))
    out = D.union_all([x.where(F.col("x") % 3 == 0), x.where(F.col("x") * 2 > 18), x.select((F.col("x") * 2).alias("x"))])
    assert sorted(r["x"] for r in out.collect()) == sorted([3, 6, 9, 10] + [2 * i for i in range(1, 11)])
    assert out.count() == 14


def test_accumulating_counts_golden(spark):
    df = spark.range(144 * 10_000)
    got = D.accumulating_counts(df, F.expr("id div 10000")).orderBy("batch").collect()
    assert [r["running_rows"] for r in got] == [10_000 * (i + 1) for i in range(144)]


def test_accumulating_table(spark, tmp_path):
    t = D.AccumulatingTable(spark, str(tmp_path / "acc"))
    assert [t.append(spark.range(i * 10, (i + 1) * 10)) for i in range(3)] == [10, 20, 30]


def test_chunk_group_list_partition_local(spark):
    # 0..1000 in 10 chunks keyed by x % 2: a key appears once per chunk -> 20 groups
    df = spark.range(0, 1001).select(F.col("id").alias("x"))
    out = D.chunk_group_list(df, F.least(F.expr("x div 101"), F.lit(9)), F.col("x") % 2, "x")
    assert out.count() == 20
    assert sum(len(r["values"]) for r in out.collect()) == 1001


def test_group_list_pieces_are_bounded(spark):
    df = spark.range(0, 5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = D.group_list(df, F.col("k"), "v", piece_rows=300).collect()
    assert max(len(r["values"]) for r in out) <= 300
    for k in (0, 1):
        pieces = sorted((r["piece"], r["values"]) for r in out if r["k"] == k)
        flat = [v for _, vs in pieces for v in vs]
        assert flat == list(range(k, 5000, 2))


def _golden_rules(spark):
    # f1..f5 are the atoms of the reference test; r1..r5 single rules, m1 and m3 multi rules
    atoms = {"f1": ("int", "int", "1"), "f2": ("str", "str", "2"), "f3": ("char", "char", "\x03"),
             "f4": ("float", "float", "4.0"), "f5": ("double", "double", "5.0")}
    singles = {"r1": (-1, ["f1"]), "r2": (0, ["f1", "f3", "f4"]), "r3": (1, ["f3", "f5"]),
               "r4": (0, ["f4", "f5"]), "r5": (1, ["f1", "f2", "f5"])}
    multis = {"m1": (0, ["r1", "r2", "r3"]), "m3": (1, ["m1", "r3", "r4", "r5"])}
    rules = spark.createDataFrame(
        [(k, "single", v[0]) for k, v in singles.items()] + [(k, "multi", v[0]) for k, v in multis.items()],
        "rule_id string, kind string, key int")
    factors = spark.createDataFrame(
        [(k, i, *atoms[a]) for k, (_, fs) in singles.items() for i, a in enumerate(fs)],
        "rule_id string, pos int, name string, vtype string, value string")
    children = spark.createDataFrame(
        [(k, i, c) for k, (_, cs) in multis.items() for i, c in enumerate(cs)],
        "parent_id string, pos long, child_id string")
    return rules, factors, children


def test_rule_flatten_and_distinct_golden(spark):
    rules, factors, children = _golden_rules(spark)
    flat = R.flatten(rules, children)
    order = [r["leaf_id"] for r in flat.orderBy("path").collect()]
    assert order == ["r1", "r2", "r3", "r3", "r4", "r5"]
    dist = R.distinct_leaves(flat, R.signatures(rules, factors))
    assert dist.count() == 5
    assert R.validate(rules, factors).count() == 0


def test_rule_equality_position_by_position(spark):
    rules = spark.createDataFrame([("a", "single", 0), ("b", "single", 0), ("c", "single", 0), ("d", "single", 1)],
                                  "rule_id string, kind string, key int")
    factors = spark.createDataFrame(
        [("a", 0, "x", "int", "1"), ("a", 1, "y", "int", "2"),
         ("b", 0, "x", "int", "1"), ("b", 1, "y", "int", "2"),
         ("c", 0, "y", "int", "2"), ("c", 1, "x", "int", "1"),   # same factors, other order
         ("d", 0, "x", "int", "1"), ("d", 1, "y", "int", "2")],  # other key
        "rule_id string, pos int, name string, vtype string, value string")
    got = {r["rule_id"]: r["class_id"] for r in R.equality_classes(rules, factors).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_rule_validate_flags_bad_keys(spark):
    rules = spark.createDataFrame([("s", "single", -1), ("m", "multi", -1), ("ok", "single", -1)],
                                  "rule_id string, kind string, key int")
    factors = spark.createDataFrame([("s", 0, "a", "int", "1"), ("s", 1, "b", "int", "2"), ("ok", 0, "a", "int", "1")],
                                    "rule_id string, pos int, name string, vtype string, value string")
    assert sorted(r["rule_id"] for r in R.validate(rules, factors).collect()) == ["m", "s"]


def test_distribution_sample_golden(spark):
    dist = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.2), (0, 2, 0.7)], "dist_id int, i int, p double")
    cums = S.cumulative(dist, "dist_id", "i", "p")
    draws = spark.createDataFrame([(0, 0.05), (0, 0.25), (0, 0.31), (0, 1.0)], "dist_id int, d double")
    got = [r["sample_index"] for r in S.sample(draws, cums, "dist_id", "d").orderBy("d").collect()]
    assert got == [0, 1, 2, 2]
    over = spark.createDataFrame([(0, 1.5)], "dist_id int, d double")
    with pytest.raises(Exception, match="exceeds"):
        S.sample(over, cums, "dist_id", "d").collect()


def test_index_series_hot_group_spans_partitions(spark):
    # one group holds most rows; it must still get a dense 0..n-1 index
    df = spark.range(0, 20_000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7)
                                       .alias("g"), F.col("id").alias("t"), (F.col("id") * 0.5).alias("v"))
    rows = S.index_series(df, ["g"], ["t"], "v").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["t"], r["idx"]))
    for g, items in by.items():
        items.sort()
        assert [i for _, i in items] == list(range(len(items))), g


def test_sample_with_retry_first_landing_draw(spark):
    dist = spark.createDataFrame([(0, 0.2), (1, 0.3)], "i int, p double")     # sums to 0.5
    cums = S.cumulative(dist, None, "i", "p")
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    # key 1 draws 0.9, 0.8, ..., key 2 always 0.99 (never lands)
    draw = lambda j: F.when(F.col("k") == 1, F.lit(0.9) - j * 0.1).otherwise(F.lit(0.99))
    got = {r["k"]: (r["draw_no"], r["sample_index"])
           for r in S.sample_with_retry(keys, cums, None, draw, strict=False).collect()}
    assert got[1] == (4, 1)          # 0.9, 0.8, 0.7, 0.6 miss; 0.5 lands at index 1
    assert got[2] == (None, None)
    with pytest.raises(Exception, match="no draw of 1000"):
        S.sample_with_retry(keys, cums, None, draw).collect()


def test_draws_that_are_null_unknown_or_too_large(spark):
    cums = S.cumulative(spark.createDataFrame([(0, i, p) for i, p in enumerate([0.25] * 4)], "d int, i int, p double"), "d", "i", "p")
    draws = [(1, 0, 0.25), (2, 0, 0.26), (3, 0, 1.0), (4, 0, None), (5, 9, 0.5), (6, 0, 1.1), (7, None, 0.5), (8, 0, 0.0)]
    df = spark.createDataFrame(draws, "n int, d int, x double")
    got = {r["n"]: (r["sample_index"], r["hit"]) for r in S.sample(df, cums, "d", "x", strict=False).collect()}
    assert got == {1: (0, True), 2: (1, True), 3: (3, True), 4: (None, None), 5: (None, False), 6: (None, False),
                   7: (None, False), 8: (0, True)}
    for n, text in ((5, "unknown distribution"), (6, "exceeds")):
        with pytest.raises(Exception, match=text):
            S.sample(df.where(F.col("n") == n), cums, "d", "x").collect()
    assert S.sample(df.where("n = 4"), cums, "d", "x").first()["sample_index"] is None


def test_placing_agrees_with_a_scan_of_the_sums(spark):
    sizes = (1, 2, 3, 7, 8, 9, 64)
    dist = spark.createDataFrame([(n, i, 0 if i % 5 == 3 else i + 1) for n in sizes for i in range(n)], "d int, i int, p int")
    sums = {n: [sum(0 if k % 5 == 3 else k + 1 for k in range(i + 1)) for i in range(n)] for n in sizes}
    draws = [(n, x / 4) for n in sizes for x in range(4 * sums[n][-1] + 1)] + [(64, 7.0)] * 500
    got = S.sample(spark.createDataFrame(draws, "d int, x double"), S.cumulative(dist, "d", "i", "p"), "d", "x").collect()
    assert sorted((r["d"], r["x"], r["sample_index"]) for r in got) == sorted((n, x, sum(c < x for c in sums[n])) for n, x in draws)


def test_one_distribution_larger_than_a_task(spark):
    # 200,000 outcomes and as many draws, half of them equal: no partition holds them all, and no array does
    n = 200_000
    dist = spark.range(n).select(F.col("id").alias("i"), F.lit(1).alias("p"))
    draws = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.lit(n / 2)).otherwise(F.col("id") + 0.5).alias("x"))
    got = S.sample(draws, S.cumulative(dist, None, "i", "p"), None, "x")
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Python" not in plan
    wrong = F.when(F.col("id") % 2 == 0, F.lit(n // 2 - 1)).otherwise(F.col("id")) != F.col("sample_index")
    assert got.count() == n and got.where(wrong | F.col("sample_index").isNull()).count() == 0


def test_negative_probabilities_are_an_error(spark):
    with pytest.raises(Exception, match="negative probability"):
        S.cumulative(spark.createDataFrame([(0, -0.1)], "i int, p double"), None, "i", "p").collect()


def test_forecast_across_blocks_and_short_series(spark, monkeypatch):
    monkeypatch.setattr(S, "LAG_BLOCK", 4)
    rows = [("a", t, 2.0 * t + 1) for t in range(23)] + [("b", 0, 5.0), ("c", 0, 1.0), ("c", 1, None), ("c", 2, 3.0), (None, 0, 1.0), (None, 1, 2.0)]
    got = {r["g"]: r for r in S.ar1_forecast(spark.createDataFrame(rows, "g string, t int, v double"), ["g"], ["t"], "v").collect()}
    assert (got["a"]["n_pairs"], round(got["a"]["slope"], 9), round(got["a"]["forecast"], 9)) == (22, 1.0, 47.0)
    assert (got["b"]["n_pairs"], got["b"]["last_value"], got["b"]["forecast"]) == (0, 5.0, None)
    assert got["c"]["n_pairs"] == 2 and got[None]["n_pairs"] == 1


def test_index_within_groups_multi_key_and_nulls(spark):
    from rivulet.functions.indexing import index_within_groups
    rows = [(a, b, t) for a in (None, 1, 2) for b in (None, "x") for t in range(50)]
    df = spark.createDataFrame(rows, "a int, b string, t int")
    for n in (1, 7):
        out = index_within_groups(df, ["a", "b"], ["t"], num_partitions=n).collect()
        assert len(out) == len(rows)
        for r in out:
            assert r["idx"] == r["t"]


def test_running_total_matches_window(spark):
    from pyspark.sql import Window
    from rivulet.functions.indexing import running_total
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"),
                                     (F.col("id") % 7).alias("v"))
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["g"], r["t"]): r["run"] for r in df.withColumn("run", F.sum("v").over(w)).collect()}
    for n in (1, 5):
        got = {(r["g"], r["t"]): r["run"] for r in running_total(df, ["g"], ["t"], "v", "run", n).collect()}
        assert got == want
        glob = running_total(df, [], ["t"], "v", "run", n).orderBy("t").collect()
        assert glob[-1]["run"] == sum(i % 7 for i in range(3000))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_index_keeps_keys_values_and_groups_apart(spark, partitions):
    """Keys beyond 2^53, a nullable bigint that is only carried, NaN and infinity, and a group of huge values before small ones."""
    from rivulet.functions.indexing import index_within_groups, running_total
    big = 2 ** 53
    rows = [(big, 0, 9007199254740993, 1e16), (big, 1, None, 1.0), (big + 1, 0, 9007199254740995, 1.0),
            (big + 1, 1, None, 1.0), (None, 0, 7, float("nan")), (None, 1, None, float("inf")), (3, 0, 8, None)]
    df = spark.createDataFrame(rows, "g long, t int, carried long, v double")
    got = {(r["g"], r["t"]): (r["idx"], r["carried"]) for r in index_within_groups(df, ["g"], ["t"], num_partitions=partitions).collect()}
    assert got == {(g, t): (t, c) for g, t, c, _ in rows}
    sums = {(r["g"], r["t"]): r["run"] for r in running_total(df, ["g"], ["t"], "v", "run", partitions).collect()}
    assert sums[(big + 1, 0)] == 1.0 and sums[(big + 1, 1)] == 2.0 and sums[(big, 1)] == 1e16 + 1.0
    assert sums[(None, 0)] != sums[(None, 0)] and sums[(None, 1)] != sums[(None, 1)] and sums[(3, 0)] == 0.0


def test_index_from_another_working_folder(tmp_path):
    """The workers need no copy of this package."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from rivulet.session import get_session\n"
            "from rivulet.functions.indexing import index_within_groups\n"
            "s = get_session('local[2]', 2)\n"
            "df = s.range(50).selectExpr('id % 3 AS g', 'id AS t')\n"
            "print('TOP', index_within_groups(df, ['g'], ['t']).agg({'idx': 'max'}).first()[0])\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "TOP 16" in out.stdout, out.stderr[-2000:]


def test_rule_values_compare_like_boxed_numbers(spark):
    rules = spark.createDataFrame([(r, "single", 0) for r in "abcde"], "rule_id string, kind string, key int")
    factors = spark.createDataFrame(
        [("a", 0, "x", "int", "1"), ("b", 0, "x", "float", "1.0"), ("c", 0, "x", "char", "\x01"),
         ("d", 0, "x", "float", "0.1"), ("e", 0, "x", "double", "0.1")],
        "rule_id string, pos int, name string, vtype string, value string")
    got = {r["rule_id"]: r["class_id"] for r in R.equality_classes(rules, factors).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    recs = R.unpivot_records(spark.createDataFrame([(7, 1.0)], "id long, x double"), "id",
                             {"x": (F.col("x"), "double")})
    assert sorted(r["rule_id"] for r in R.match_rules(recs, rules, factors).collect()) == ["a", "b", "c"]


def test_rule_flatten_detects_cycle(spark):
    rules = spark.createDataFrame([("m1", "multi", 0), ("m2", "multi", 0), ("root", "multi", 0), ("s", "single", 0)],
                                  "rule_id string, kind string, key int")
    children = spark.createDataFrame([("root", 0, "m1"), ("m1", 0, "m2"), ("m2", 0, "m1"), ("m2", 1, "s")],
                                     "parent_id string, pos long, child_id string")
    with pytest.raises(ValueError, match="cycle"):
        R.flatten(rules, children)


def test_hot_group_is_spread_over_partitions(spark):
    """A group holding a third of the rows must not land in one partition."""
    from rivulet.functions import indexing
    df = spark.range(0, 30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("g"), F.col("id").alias("t"))
    ranged = (df.repartitionByRange(8, "g", "t").sortWithinPartitions("g", "t")
              .withColumn("_pid", F.spark_partition_id()))
    sizes = [r["n"] for r in ranged.groupBy("_pid").agg(F.count("*").alias("n")).collect()]
    hot_parts = ranged.where("g = -1").select("_pid").distinct().count()
    assert hot_parts >= 2
    assert max(sizes) < 2 * (30_000 / 8)
    idx = indexing.index_within_groups(df, ["g"], ["t"], num_partitions=8).where("g = -1")
    assert idx.agg(F.max("idx")).first()[0] == 9_999


def test_window_frame_sums_each_frame_by_itself(spark, tmp_path):
    """A huge value leaves the frame without a trace."""
    from rivulet.plans.q_passthrough import pt_window_frame
    import datetime
    rows = [(i, 1, datetime.datetime(2024, 1, 1, 0, i), v) for i, v in enumerate([1e16, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["moving_sum_cents"] for r in pt_window_frame(spark, str(tmp_path)).collect()}
    assert [got[i] for i in (4, 5, 6)] == [400, 400, 400]


def test_running_total_keeps_index(spark):
    from rivulet.functions.indexing import running_total
    df = spark.range(0, 500).select((F.col("id") % 2).alias("g"), F.col("id").alias("t"), F.lit(1).alias("one"))
    out = running_total(df, ["g"], ["t"], "one", "run", index_name="i").collect()
    assert len(out) == 500 and all(r["run"] == r["i"] + 1 for r in out)


def test_running_total_several_columns_with_nulls(spark):
    from rivulet.functions.indexing import running_total
    rows = [(1, t, None if t % 3 == 0 else float(t)) for t in range(40)]
    df = spark.createDataFrame(rows, "g int, t int, v double").withColumn(
        "has", F.col("v").isNotNull().cast("int"))
    out = running_total(df, ["g"], ["t"], ["v", "has"], ["rv", "rn"]).orderBy("t").collect()
    assert [r["rn"] for r in out] == [sum(1 for x in range(t + 1) if x % 3) for t in range(40)]
    assert [r["rv"] for r in out] == [float(sum(x for x in range(t + 1) if x % 3)) for t in range(40)]


def test_group_list_with_one_repeated_value(spark):
    df = spark.range(0, 900).select(F.lit("k").alias("k"), F.lit(5).alias("v"))
    out = D.group_list(df, F.col("k"), "v", piece_rows=100).collect()
    assert sorted((r["piece"], len(r["values"])) for r in out) == [(i, 100) for i in range(9)]


def _singles(spark, rules):
    """rules: {id: (key, [(name, vtype, value)])}"""
    r = spark.createDataFrame([(k, "single", v[0]) for k, v in rules.items()], "rule_id string, kind string, key int")
    f = spark.createDataFrame([(k, i, *x) for k, v in rules.items() for i, x in enumerate(v[1])],
                              "rule_id string, pos int, name string, vtype string, value string")
    return r, f


def test_rule_equality_with_separators_bad_values_and_nulls(spark):
    r, f = _singles(spark, {
        "a": (0, [("a", "str", "1;b=s:2")]), "b": (0, [("a", "str", "1"), ("b", "str", "2")]),
        "c": (0, [("x", "int", "oops")]), "d": (0, [("x", "int", "99999999999999999999")]), "e": (0, [("x", "str", None)]),
        "f": (0, [("x", "int", None)]), "g": (0, [("x", "int", "oops")]), "h": (0, []), "i": (None, []), "j": (0, []),
        "k": (0, [("x", "str", "oops")])})
    got = {x["rule_id"]: (x["class_id"], x["class_size"]) for x in R.equality_classes(r, f).collect()}
    assert got == {"a": ("a", 1), "b": ("b", 1), "c": ("c", 2), "d": ("d", 1), "e": ("e", 2), "f": ("e", 2), "g": ("c", 2),
                   "h": ("h", 2), "i": ("i", 1), "j": ("h", 2), "k": ("k", 1)}


def test_rule_paths_of_any_position(spark):
    rules = spark.createDataFrame([("root", "multi", 0), ("m", "multi", 0)] + [(x, "single", 0) for x in "abcdz"], "rule_id string, kind string, key int")
    children = spark.createDataFrame(
        [("root", 1234567890124, "b"), ("root", 1234567890123, "a"), ("root", -1, "d"), ("root", -2, "c"), ("root", 5, "m"), ("m", 0, "a")],
        "parent_id string, pos long, child_id string")
    flat = R.flatten(rules, children)
    assert [(r["root_id"], r["leaf_id"], list(r["path"])) for r in flat.orderBy("root_id", "path").collect()] == [
        ("root", "c", [-2]), ("root", "d", [-1]), ("root", "a", [5, 0]), ("root", "a", [1234567890123]),
        ("root", "b", [1234567890124]), ("z", "z", [])]


def test_single_rule_as_root_is_its_own_leaf(spark):
    rules, _factors, children = _golden_rules(spark)
    roots = spark.createDataFrame([("r1",), ("m1",)], "rule_id string")
    got = [(r["root_id"], r["leaf_id"], r["depth"]) for r in R.flatten(rules, children, roots).orderBy("root_id", "path").collect()]
    assert got == [("m1", "r1", 1), ("m1", "r2", 1), ("m1", "r3", 1), ("r1", "r1", 0)]


def test_deep_rule_chain(spark):
    n = 25
    rules = spark.createDataFrame([(f"m{i}", "multi", 0) for i in range(n)] + [("s", "single", 0)], "rule_id string, kind string, key int")
    children = spark.createDataFrame([(f"m{i}", 0, f"m{i + 1}") for i in range(n - 1)] + [(f"m{n - 1}", 0, "s")], "parent_id string, pos long, child_id string")
    got = R.flatten(rules, children).collect()
    assert [(r["root_id"], r["leaf_id"], r["depth"]) for r in got] == [("m0", "s", n)]


def test_frequent_values_are_dealt_by_their_counts(spark):
    rules, factors = _singles(spark, {"hot": (0, [("x", "int", "0"), ("y", "int", "7")]), "one": (1, [("x", "int", "0"), ("y", "int", "9")])})
    data = spark.range(5000).selectExpr("id", "CAST(id % 3 > 0 AS INT) - 0 AS x", "id % 100 AS y")
    rec = R.unpivot_records(data, "id", {"x": (F.col("x"), "int"), "y": (F.col("y"), "int")})
    assert rec.where("fields IS NOT NULL").count() == 5000     # one map a record
    got = sorted((r["rule_id"], r["record_id"]) for r in R.match_rules(rec, rules, factors).collect())
    want = [("hot", i) for i in range(5000) if i % 3 == 0 and i % 100 == 7] + [("one", i) for i in range(5000) if i % 3 == 0 or i % 100 == 9]
    assert got == sorted(want)
    atoms = spark.createDataFrame([("x", "int", "0")], "name string, vtype string, value string")
    assert sorted(r["record_id"] for r in R.match_atoms(rec, atoms).collect()) == [i for i in range(5000) if i % 3 == 0]


def test_match_all_checks_every_factor(spark):
    r, f = _singles(spark, {
        "all": (0, [("x", "int", "1"), ("y", "str", "u")]), "same": (0, [("x", "int", "1"), ("x", "int", "1")]),
        "never": (0, [("x", "int", "1"), ("y", "str", None)]), "absent": (0, [("x", "int", "1"), ("z", "int", "1")]),
        "any": (1, [("x", "int", "1"), ("y", "str", "u")]), "both": (0, [("x", "int", "1"), ("x", "int", "2")])})
    rec = R.unpivot_records(spark.createDataFrame([(1, 1, "u"), (2, 1, "v"), (3, None, "u"), (4, 2, None)], "id long, x int, y string"),
                            "id", {"x": (F.col("x"), "int"), "y": (F.col("y"), "str")})
    got = sorted((x["rule_id"], x["record_id"]) for x in R.match_rules(rec, r, f).collect())
    assert got == [("all", 1), ("any", 1), ("any", 2), ("any", 3), ("same", 1), ("same", 2)]


def test_result_json_of_an_empty_result(spark):
    import json
    from rivulet.operators import service as V
    rows = V.json_chunks(spark.range(5).where("id > 9"), ["id"]).collect()
    assert [(r["chunk_no"], json.loads(r["json"])) for r in rows] == [(0, {"msg": "get result succeed", "resultCode": 0})]
    rows = V.json_chunks(spark.range(5), ["id"], chunk_rows=2).orderBy("chunk_no").collect()
    assert [json.loads(r["json"])["data"] for r in rows] == [["[0]", "[1]"], ["[2]", "[3]"], ["[4]"]]


def test_error_text_is_whole(spark):
    import json
    from rivulet.operators import service as V
    name = "missing_" + "x" * 900
    df, resp = V.try_sql(spark, f"SELECT {name} FROM range(1)")
    msg = json.loads(resp.first()["json"])["msg"]
    assert df is None and name in msg and msg.count("\n") >= 1


def _rule_tables(spark, kinds: dict, edges: list):
    rules = spark.createDataFrame([(r, k, 0) for r, k in kinds.items()], "rule_id string, kind string, key int")
    return rules, spark.createDataFrame(edges, "parent_id string, pos long, child_id string")


@pytest.mark.parametrize("edges, said", [
    ([("a", 0, "b"), ("b", 0, "a"), ("b", 1, "s")], "cycle"),            # no root reaches it
    ([("a", 0, "a")], "cycle"),
    ([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("r", 0, "s")], "cycle"),
    ([("r", 0, "a"), ("a", 0, "b"), ("a", 1, "b"), ("b", 0, "c"), ("b", 1, "c"), ("c", 0, "a"), ("c", 1, "a")], "cycle"),
    ([("r", 0, "s"), ("r", 1, "nobody")], "unknown rules: nobody"),
    ([("ghost", 0, "s")], "unknown rules: ghost"),
])
def test_broken_rule_trees_are_errors(spark, edges, said):
    rules, children = _rule_tables(spark, {"r": "multi", "a": "multi", "b": "multi", "c": "multi", "s": "single"}, edges)
    with pytest.raises(ValueError, match=said):
        R.flatten(rules, children)


def test_shared_subtrees_and_nested_roots(spark):
    """A rule below several parents is listed once for each way to it; a root may lie below another."""
    rules, children = _rule_tables(
        spark, {"r": "multi", "a": "multi", "b": "multi", "s": "single", "t": "single", "lone": "single", "none": "multi"},
        [("r", 0, "a"), ("r", 5, "b"), ("a", 1, "b"), ("a", 2, "s"), ("b", 3, "s"), ("b", 4, "t"), ("b", 9, "t")])
    got = sorted((x["root_id"], x["leaf_id"], x["depth"], list(x["path"])) for x in R.flatten(rules, children).collect())
    down = [("s", [3]), ("t", [4]), ("t", [9])]
    want = [("r", leaf, len(head + p), head + p) for head in ([0, 1], [5]) for leaf, p in down] + [("r", "s", 2, [0, 2]), ("lone", "lone", 0, [])]
    assert got == sorted(want)
    some = R.flatten(rules, children, spark.createDataFrame([("a",), ("b",), ("t",)], "rule_id string")).collect()
    want = [("a", leaf, 1 + len(p), [1, *p]) for leaf, p in down] + [("a", "s", 1, [2]), ("t", "t", 0, [])] + [("b", leaf, 1, p) for leaf, p in down]
    assert sorted((x["root_id"], x["leaf_id"], x["depth"], list(x["path"])) for x in some) == sorted(want)


def test_a_chain_of_ten_thousand_levels(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth."""
    n, saved = 10_000, []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, f=frame.checkpoint: (saved.append(1), f(self, *a))[1])
    node = F.concat(F.lit("m"), F.col("id").cast("string"))
    rules = spark.range(n).select(node.alias("rule_id"), F.lit("multi").alias("kind"), F.lit(0).alias("key")) \
        .unionByName(spark.range(1).select(F.lit("leaf").alias("rule_id"), F.lit("single").alias("kind"), F.lit(0).alias("key")))
    below = F.when(F.col("id") == n - 1, F.lit("leaf")).otherwise(F.concat(F.lit("m"), (F.col("id") + 1).cast("string")))
    children = spark.range(n).select(node.alias("parent_id"), (F.col("id") % 7).alias("pos"), below.alias("child_id"))
    (got,) = R.flatten(rules, children).collect()
    assert (got["root_id"], got["leaf_id"], got["depth"]) == ("m0", "leaf", n)
    assert list(got["path"]) == [i % 7 for i in range(n)]
    assert len(saved) <= 2 * 15 + 1
