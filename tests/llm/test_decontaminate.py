import hashlib
import random
import re

import duckdb
import numpy as np

from rivulet.llm.decontaminate import FMIndex, contamination, op8_decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=13):
    windows = {}
    for name, text in items:
        w = WORD.findall((text or "").encode().lower())
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("null" if name is None else str(name))
    out = []
    for text in docs:
        w = WORD.findall((text or "").encode().lower())
        hit, names = [False] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    names |= windows[x]
                    hit[k : k + size] = [True] * size
        n = sum(hit)
        out.append((len(w), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return out


def test_word_hashes_do_not_depend_on_the_pieces():
    from rivulet.llm.wordindex import WordHasher, alnum_table

    rng = np.random.default_rng(4)
    rows = [bytes(rng.choice(list(b"ab9 ,\xc3\xa9"), n)) for n in (0, 5, 300, 1, 90)] + [b"x" * 200, b"  "]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    data = np.frombuffer(b"".join(rows), np.uint8)
    want = [(i, w) for i, r in enumerate(rows) for w in WORD.findall(r)]
    whole = WordHasher().words(data, offsets, alnum_table())
    assert [(int(i), data[a:b].tobytes()) for a, b, i in zip(*whole[:3])] == want
    for most in (1, 7, 50):
        for x, y in zip(whole, WordHasher().words(data, offsets, alnum_table(), most)):
            assert np.array_equal(x, y)
    by_hash = {}
    for h, (_, w) in zip(whole[3], want):
        assert by_hash.setdefault(int(h), w) == w
    assert len(by_hash) == len({w for _, w in want})


def test_index_counts_and_locates():
    rng = np.random.default_rng(3)
    for symbols, n in ((1, 40), (3, 300), (50, 500)):
        text = rng.integers(1, symbols + 1, n)
        index = FMIndex(text)
        patterns = [tuple(text[i : i + k]) for k in (1, 2, 5, 13) for i in rng.integers(0, n - 13, 10)] + [(symbols + 3, 1), (1, symbols + 9)]
        table = np.zeros((len(patterns), 13), np.int64)
        for i, p in enumerate(patterns):
            table[i, 13 - len(p) :] = p
        low, high = index.search(table, np.array([len(p) for p in patterns]))
        for p, lo, hi in zip(patterns, low, high):
            want = [i for i in range(n - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(lo, hi))) == want


def test_matches_brute_force(spark, sf_dir, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    want = dict(zip([i for i, _, _ in documents], brute([t for _, t, _ in documents], items)))
    got = op8_decontaminate(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_small_vocabulary_short_items_and_blocks(spark, store):
    """Few words, so windows overlap and recur; items shorter than a window; several benchmark blocks."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d9", "é"]) for _ in range(n))
    docs = [text(rng.randrange(0, 400)) for _ in range(60)] + ["", "!!", "a,b-c"]
    items = [(i, text(rng.choice([1, 3, 6, 13, 14, 20]))) for i in range(25)] + [(3, text(4)), (None, "zzz zzz"), (77, None), (78, " ; ")]
    docs += ["word zzz ZZZ word", items[0][1]]
    table = store([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    benchmark = store(items, "item_id long, text string")
    want = brute(docs, items)
    for size in (20_000, 5):
        got = contamination(table, benchmark, block_items=size).orderBy("doc_id").collect()
        assert [tuple(r)[2:7] for r in got] == want


def test_odd_rows(spark, odd, store, none):
    benchmark = store([(9, "words here in this")], "item_id long, text string")
    got = contamination(odd, benchmark)
    assert got.columns[: len(odd.columns)] == odd.columns and "_n_words" in got.columns
    rows = got.select("doc_id", "_n_words", "n_hit", "contaminated").collect()
    assert len(rows) == 10
    for r in rows:
        assert r.contaminated == (r.doc_id in (1, 2, None)) and (r.n_hit == (4 if r.contaminated else 0))
        assert r["_n_words"] == {1: 7, 2: 7, None: 7, 3: 0, 4: 0, 5: 0, 6: 1, 7: 120_000, 8: 6}[r.doc_id]
    assert contamination(none, benchmark).collect() == []
    empty = contamination(odd, none.selectExpr("doc_id AS item_id", "text")).select("n_hit").collect()
    assert {r.n_hit for r in empty} == {0} and len(empty) == 10
