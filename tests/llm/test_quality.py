import itertools

import duckdb
import numpy as np
import pyarrow as pa

from rivulet.llm import quality as Q

TEXTS = ["Plain words, plain words here.", "SHOUT!! SHOUT!! A!!", "the the the the", "a | b | c | 12 4x", "", None, "Été déjà vu\nà 2%% ", "x"]


def plain_terms(text):
    """The text's terms by name, word by word."""
    words = (text or "").encode().split()

    def kind(b):
        c = chr(b)
        return "a" if b >= 128 or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c

    shapes = ["".join(k for k, _ in itertools.groupby(map(kind, w))) for w in words]
    out = [("shape", s) for s in shapes] + [("pair", *p) for p in zip(shapes, shapes[1:])] + [("short", w) for w in words if len(w) <= 3]
    out += [(f"again{b}",) for b in (1, 2) for x, y in zip(words, words[b:]) if x == y]
    return out or [("none",)]


def counts_of(texts):
    return np.concatenate([c for _, c in Q.Terms().counts(pa.array(texts, pa.string()))])


def test_terms_match_a_plain_version():
    """Each plain term has one number, in the range of its kind, and the counts agree."""
    number = {}
    for name in {t for text in TEXTS for t in plain_terms(text)}:
        number[name] = None
    counts = counts_of(TEXTS)
    for text, row in zip(TEXTS, counts):
        names = plain_terms(text)
        for lo, hi, kinds in [(0, 1, ("none",)), (Q.SHAPES, Q.PAIRS, ("shape",)), (Q.PAIRS, Q.SHORT, ("pair",)), (Q.SHORT, Q.REPEATS, ("short",)), (Q.REPEATS + 1, Q.REPEATS + 2, ("again1",)), (Q.REPEATS + 2, Q.TERMS, ("again2",))]:
            mine = [n for n in names if n[0] in kinds]
            assert sorted(row[lo:hi][row[lo:hi] > 0]) == sorted(len(list(g)) for _, g in itertools.groupby(sorted(mine, key=str))), (text, kinds)


def test_rows_do_not_touch_and_long_texts_count_whole():
    both = counts_of(["end", "end end", "end"])
    assert both[0].tolist() == both[2].tolist() == counts_of(["end"])[0].tolist()
    long = "Some words of a long text, " * 200_000
    (one,) = counts_of([long])
    assert one[Q.SHAPES : Q.PAIRS].sum() == 6 * 200_000
    assert abs(one[Q.PAIRS : Q.SHORT].sum() - 6 * 200_000) <= 2 + len(long) // (Q.PIECE // 2)


def test_votes_match_a_full_sort():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.05, (300, Q.TERMS)).astype(float)
    idf = rng.random(Q.TERMS) + 1
    axes = Q.leading(Q.weighted(counts[:200], idf), 20)
    y, w = (rng.random(200) < 0.6).astype(float), rng.random(200) + 0.5
    model = Q.Model(idf, axes, Q.unit(Q.weighted(counts[:200], idf) @ axes), y, w)
    got = model.scores(counts[200:], 15)
    for row, score in zip(counts[200:], got):
        v = np.sqrt(row / row.sum()) * idf @ axes
        near = model.vectors @ (v / np.linalg.norm(v))
        top = sorted(range(200), key=lambda i: (-round(near[i], 6), i))[:15]
        vote = [max(near[i], 0) * w[i] for i in top]
        assert abs(score - sum(a * y[i] for a, i in zip(vote, top)) / sum(vote)) < 1e-4


def test_axes_span_the_leading_singular_vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 200)) + 0.001 * rng.normal(size=(80, 200))
    want = np.linalg.svd(x)[2][:6].T
    got = Q.leading(x, 6)
    assert np.allclose(want @ (want.T @ got), got, atol=1e-3)


def test_held_out(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = Q.op12_quality(spark, sf).collect()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    good, junk = ([r for r in held if quality[r.doc_id] == k] for k in (1, 0))
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(r.predicted for r in junk) <= 0.15 * len(junk)


def test_frequencies_cover_all_documents(spark, store):
    docs = store([(i, t, None) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string, lang string")
    total, held = Q.document_frequency(docs)
    assert total == 3 * len(TEXTS) and held.tolist() == (3 * (counts_of(TEXTS) > 0).sum(axis=0)).tolist()


def test_odd_rows(spark, odd, none, store):
    labels = store([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (7, 1), (8, 1)], "doc_id long, quality int")
    model = Q.train(odd, labels)
    assert len(model.labels) == 4
    got = Q.score(odd, model)
    assert got.columns[: len(odd.columns)] == odd.columns and "_score" in got.columns
    rows = got.select("doc_id", "_score", "predicted").collect()
    assert len(rows) == 10 and all(0 <= r._score <= 1 for r in rows)
    of = {r.doc_id: r._score for r in rows}
    assert of[3] == of[4] == of[5] and len({r._score for r in rows if r.doc_id == 1}) == 1
    assert Q.score(none, model).collect() == []
    assert {r._score for r in Q.score(odd, Q.train(none, labels)).collect()} == {0.5}
    assert len(Q.train(none, store([], "doc_id long, quality int")).labels) == 0
