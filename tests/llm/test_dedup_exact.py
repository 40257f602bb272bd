import hashlib
import re
from collections import defaultdict

from rivulet.llm import dedup_exact
from rivulet.llm.dedup_exact import exact_dedup, op4_exact_dedup


def brute(rows):
    """Rows of (number, doc_id, text) -> expected result by number."""
    groups = defaultdict(list)
    for n, i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    out = {}
    for t, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (m[4], best[4], len(members), m is best, hashlib.sha256(t.encode()).hexdigest())
    return out


def test_matches_brute_force(spark, sf_dir, documents):
    want = brute([(i, i, t) for i, t, _ in documents])
    got = op4_exact_dedup(spark, sf_dir).collect()
    assert len(got) == len(documents)
    assert {r.doc_id: tuple(r) for r in got} == want


def test_hot_group_is_salted_and_one_row_stays(store, monkeypatch):
    monkeypatch.setattr(dedup_exact, "HOT_SHARE", 10)
    rows = [(i, "a  copy\n of it" if i % 3 else f"own {i}") for i in range(300)] + [(900, "a copy   of   it"), (901, "ac opyofit")]
    got = exact_dedup(store(rows, "doc_id long, text string")).collect()
    want = brute([(i, i, t) for i, t in rows])
    assert {r.doc_id: tuple(r[1:]) for r in got} == want
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_texts_under_one_digest_stay_apart(store, monkeypatch):
    """With a digest that says nothing, only the comparison of whole texts tells groups apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup_exact.F, "sha2", lambda c, n: F.lit("0" * 64))
    rows = [(i, f"text {i % 4}") for i in range(20)] + [(50, None)]
    got = exact_dedup(store(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {k: v[1:4] for k, v in brute([(i, i, t) for i, t in rows]).items()}


def test_odd_rows(odd):
    got = exact_dedup(odd).collect()
    assert len(got) == 10
    same = [r for r in got if r.group_size == 4]
    assert len(same) == 4 and sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {1}
    empty = {r.doc_id: r for r in got if r.doc_id in (3, 4, 5)}
    assert {r.keep_id for r in empty.values()} == {5} and empty[5].kept and not empty[3].kept


def test_empty_table(none):
    assert exact_dedup(none).collect() == []


def test_plan_has_no_python(spark, sf_dir):
    plan = op4_exact_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_matches_its_sql(spark, sf_dir):
    import duckdb

    documents = duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet'")  # noqa: F841
    want = sorted(duckdb.sql(dedup_exact.OP4_SQL).fetchall())
    assert sorted(map(tuple, op4_exact_dedup(spark, sf_dir).collect())) == want
