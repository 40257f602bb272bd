from pyspark.sql import functions as F

from rivulet.llm.language import UNKNOWN, identify, learnt, op5_language, train


def test_held_out_accuracy(spark, sf_dir, documents):
    lang = {i: k for i, _, k in documents}
    got = op5_language(spark, sf_dir).collect()
    assert len(got) == len(documents)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_of_two_languages(spark, sf_dir, documents):
    """A text made of one English and two French documents is a mixture with French ahead."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learnt(docs)
    long = {k: [t for _, t, x in documents if x == k and 1700 < len(t)] for k in ("en", "fr")}
    mixed = [(i, long["en"][i][:800] + "\n" + long["fr"][i][:1600]) for i in range(min(5, len(long["en"]), len(long["fr"])))]
    assert len(mixed) >= 3
    for r in identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect():
        assert r.lang_pred == "fr" and [x.lang for x in r.languages] == ["fr", "en"]
        assert 0.5 < r.score < 0.85 and abs(sum(x.share for x in r.languages) - 1) < 1e-6


def test_odd_rows(spark, odd):
    model = train(odd.withColumn("lang", F.when(F.col("doc_id") == 8, "zz").otherwise(F.col("lang"))))
    assert model[0] == ["x", "y", "zz"]
    got = identify(odd, model)
    assert "_lang_pred" in got.columns and "_score" in got.columns and "lang_pred" in got.columns
    got = got.select("doc_id", "_lang_pred", "_score").collect()
    assert len(got) == 10
    for r in got:
        if r.doc_id in (3, 4, 5, 6):
            assert (r["_lang_pred"], r["_score"]) == (UNKNOWN, 0.0)
        else:
            assert r["_lang_pred"] != UNKNOWN


def test_empty_table(spark, none, odd):
    assert identify(none, train(odd)).collect() == []
    nothing = train(none)
    assert nothing[0] == []
    assert {r._lang_pred for r in identify(odd, nothing).select("_lang_pred").collect()} == {UNKNOWN}
