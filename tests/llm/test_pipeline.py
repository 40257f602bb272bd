import corpus_pipeline
import duckdb
from test_dedup_exact import brute as brute_exact
from test_decontaminate import brute as brute_benchmark
from test_simhash import brute_classes, brute_fingerprint


def test_stages_are_declared():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark, sf_dir, documents):
    rows = [(i, t) for i, t, _ in documents if any(c.isalpha() for c in t or "")]
    exact = brute_exact([(i, i, t) for i, t in rows])
    rows = [(i, t) for i, t in rows if exact[i][3]]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots, first = brute_classes(set(prints.values()), 4), {}
    for i, p in prints.items():
        first[roots[p]] = min(i, first.get(roots[p], i))
    rows = [(i, t) for i, t in rows if first[roots[prints[i]]] == i]
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    rows = [i for (i, _), x in zip(rows, brute_benchmark([t for _, t in rows], items)) if not x[4]]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows) and len(rows) < len(documents)


def test_every_stage_keeps_the_columns(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, none, sf_dir).columns == none.columns
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and {r.kept for r in out.select("kept").collect()} <= {"mine"}
    kept = [corpus_pipeline.STAGES[i][1](spark, odd, sf_dir).select("doc_id", "text").collect() for i in range(4)]
    assert [r.doc_id for r in kept[1] if r.text and r.text.startswith("same")] == [1]
    assert corpus_pipeline.STAGES[4][1](spark, odd, sf_dir).count() == 10
