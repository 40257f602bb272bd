import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm import suffix_dedup
from rivulet.llm.suffix_dedup import op7_suffix_dedup, repeated_bytes, segments


def brute(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone, upto = bytearray(len(b)), 0
        for x in range(len(b) - length + 1):
            if seen[b[x : x + length]] > 1:
                gone[max(x, upto) : x + length] = b"\1" * (x + length - max(x, upto))
                upto = x + length
        kept = bytes(v for v, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(table, texts, length=200):
    got = repeated_bytes(table, length=length).orderBy("doc_id").collect()
    want = brute(texts, length)
    assert [tuple(r)[1:5] for r in got] == want
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_matches_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: tuple(r)[1:] for r in op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == dict(zip([i for i, _, _ in documents], brute([t for _, t, _ in documents])))
    assert any(x[1] for x in got.values())


def made(seed):
    """Texts over a few letters with shared passages of lengths around the limit, edits, runs and periods."""
    rng = random.Random(seed)
    word = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passages = [word(n) for n in (150, 198, 199, 200, 201, 260, 500, 900)]
    texts = []
    for i in range(60):
        t = "".join(rng.choice([word(rng.randrange(0, 300)), rng.choice(passages), rng.choice(passages)[rng.randrange(120) :]]) for _ in range(rng.randrange(1, 6)))
        if i % 7 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + "é" + t[at:]
        texts.append(t)
    return texts + ["a" * 700, "a" * 199, "ab" * 400, word(300, "xy"), "", None, passages[-1], passages[-1], "z" * 200, word(37) * 30]


@pytest.mark.parametrize("seed", [1, 2])
def test_made_texts(store, seed):
    texts = made(seed)
    check(store([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts)


def test_groups_of_many_blocks(store, monkeypatch):
    """Blocks of three members: windows have to meet across blocks by their hash."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    texts = made(3)
    check(store([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts)


def test_long_texts_in_pieces(store, monkeypatch):
    """Pieces of 700 bytes: repeats cross their borders."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    texts = made(5)
    texts += ["".join(t for t in texts[:20] if t), "".join(t for t in texts[3:24] if t)]
    check(store([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts)


def test_other_length(store):
    texts = made(4)
    check(store([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts, 120)
    with pytest.raises(ValueError):
        repeated_bytes(store([], "doc_id long, text string"), length=50)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 105, n, dtype=np.uint8) for n in (0, 199, 200, 201, 5000, 20, 900)] + [np.full(600, 97, np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, anchor, first, last, _, _ = segments(offsets, np.concatenate(texts))
    windows = Counter(x for lo, hi in zip(first, last) for x in range(lo, hi + 1))
    assert windows == Counter(int(o + x) for o, t in zip(offsets, texts) for x in range(len(t) - 199))
    assert ((anchor >= last) & (anchor - first <= 120)).all()


def test_odd_rows(odd, none):
    got = repeated_bytes(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[7].n_removed == by[7].n_bytes and by[7].n_spans == 1
    assert by[3].n_bytes == by[4].n_bytes == 0 and by[1].n_removed == 0
    assert repeated_bytes(none).collect() == []


def test_every_large_group_is_split(spark, store, monkeypatch):
    """However small a share of all contexts it is; the others stay whole."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    contexts = store([(s, i, i) for i, s in enumerate([-1] * 10 + [-2] * 4 + [-3] * 3 + list(range(20_000)))], "suffix long, _row long, low int")
    got = suffix_dedup.in_blocks(contexts)
    assert got.count() == 20_017
    assert {(r.suffix, r.blocks) for r in got.where("blocks > 1").collect()} == {(-1, 4), (-2, 2)}
    assert got.where("block < 0 OR block >= blocks").count() == 0 and got.where("suffix = -1").select("block").distinct().count() > 1


def test_anchor_in_many_contexts(spark, store):
    """A line of 90 bytes among bytes of its own in each text: nothing recurs but where the neighbourhood does too."""
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    own = lambda n: "".join(rng.choice("ijklmnopq") for _ in range(n))
    texts = [own(130) + line + own(130) for _ in range(800)] + [own(40) + line] * 2 + [own(130) + line + own(60)] * 2
    texts += [t[:rng.randrange(205, 300)] for t in texts[:30]]
    check(store([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), texts)


def test_no_task_holds_the_contexts_of_an_anchor(spark, store):
    """One key holds half of all segments, each in a context of its own; a third key recurs in one context only."""
    place = lambda at: at << 30 | 1 << 16 | 1
    rows = [(i, -7, i, place(300)) for i in range(30_000)] + [(i, i, i, place(700)) for i in range(30_000)] + [(1, -9, 5, place(900)), (2, -9, 5, place(900))]
    found = store(rows, suffix_dedup._SEGMENT)
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counted = suffix_dedup.stored(suffix_dedup.counted(found), "counted")
        ends = suffix_dedup.open_ends(counted)
        got = ends.withColumn("task", F.spark_partition_id()).toPandas()
        plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (suffix_dedup.counted(found), ends)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 30_000 and (got["at"] == 300).all() and got["asks"].all()
    assert got.groupby("task").size().max() < 6_000
    windows = [w for plan in plans for w in plan.split("windowspecdefinition(")[1:]]
    assert windows and all(w.startswith("key") and "context" in w[:40] for w in windows)
    assert [tuple(r) for r in counted.where("place & 1 = 1").selectExpr("_row", suffix_dedup._AT).orderBy("_row").collect()] == [(1, 900), (2, 900)]
