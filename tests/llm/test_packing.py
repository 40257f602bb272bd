import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.llm.packing import best_boundaries, bin_of, op6_packing, pack, token_count, word_count

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def padded(edges, counts, bounds):
    return sum(n * min(b for b in bounds if b >= e) for e, n in zip(edges, counts))


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        edges = sorted(rng.sample(range(1, 400), rng.randint(1, 9)))
        counts = [rng.randint(1, 50) for _ in edges]
        buckets = rng.randint(1, 5)
        got = best_boundaries(np.array(edges), np.array(counts), buckets)
        best = min(padded(edges, counts, (*c, edges[-1])) for k in range(min(buckets, len(edges))) for c in itertools.combinations(edges[:-1], k))
        assert len(got) <= buckets and got[-1] == edges[-1] and padded(edges, counts, got) == best


def test_bins_round_up_to_eight_bits(spark):
    n = [0, 1, 2, 255, 256, 257, 511, 512, 513, 1000, 123_457, 10**9 + 1]
    got = [r.e for r in spark.createDataFrame([(x,) for x in n], "n long").select(bin_of(F.col("n")).alias("e")).collect()]
    assert got[:6] == [0, 1, 2, 255, 256, 258]
    for x, e in zip(n, got):
        assert x <= e <= x * (1 + 2**-7) + 1 and (e == 0 or e >> max(0, e.bit_length() - 8) << max(0, e.bit_length() - 8) == e)


@pytest.mark.parametrize("budget", [64, 2000, 65536])
def test_batches(spark, sf_dir, documents, budget):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs, buckets=6, token_budget=budget).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in documents)
    words = {i: len(t.split(" ")) for i, t, _ in documents if "\n" not in t and "  " not in t and "\t" not in t}
    assert all(r.n_tokens == words[r.doc_id] for r in rows if r.doc_id in words and not documents[0][1].endswith(" "))
    batches = {}
    for r in rows:
        assert 0 <= r.padding == r.bucket_len - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert len({r.bucket for r in rows}) <= 6 and len({(r.bucket, r.bucket_len) for r in rows}) == len({r.bucket for r in rows})
    last = {b: max(k for x, k in batches if x == b) for b, _ in batches}
    for (b, k), members in batches.items():
        full = max(1, budget // max(1, members[0].bucket_len))
        assert sorted(m.position for m in members) == list(range(len(members)))
        assert len(members) == full or (k == last[b] and len(members) < full)


def test_registered_query_covers_all(spark, sf_dir, documents):
    assert op6_packing(spark, sf_dir).count() == len(documents)


def test_odd_rows(odd, none):
    rows = pack(odd, buckets=3, token_budget=100).collect()
    assert len(rows) == 10
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert [r.n_tokens for r in rows if r.doc_id == 7] == [120_000]
    assert len({(r.bucket, r.batch, r.position) for r in rows}) == 10
    assert pack(none).collect() == []


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file here")
def test_lengths_by_a_tokenizer(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in pack(docs, length=token_count(spark, F.col("text"), TOKENIZER)).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t, _ in documents}


def test_words_are_split_at_white_space_only(spark):
    df = spark.createDataFrame([("a b\tc\nd e",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [4, 0, 0]


def plain_boundaries(edges, counts, buckets):
    """The least padded total by the plain recurrence over all splits."""
    total = [0, *itertools.accumulate(counts)]
    cost = [0] + [float("inf")] * len(edges)
    for _ in range(buckets):
        cost = [0] + [min(cost[i] + (total[j] - total[i]) * edges[j - 1] for i in range(j)) for j in range(1, len(edges) + 1)]
    return cost[-1]


def test_boundaries_of_many_long_lengths(monkeypatch):
    rng = random.Random(8)
    for step in (1 << 22, 50):
        monkeypatch.setattr("rivulet.llm.packing.STEP", step)
        for n in (1, 2, 3, 64, 127, 150):
            edges = sorted(rng.sample(range(0, 30_000), n))
            counts = [rng.choice([1, 2, 5, 300]) for _ in edges]
            got = best_boundaries(np.array(edges), np.array(counts), 6)
            assert len(got) <= 6 and got[-1] == edges[-1] and padded(edges, counts, got) == plain_boundaries(edges, counts, 6)


def test_padding_is_least_above_256_words(store):
    """A hot length and odd long ones: the padding of ``pack`` is the least there is, to lengths of documents."""
    rng = random.Random(6)
    lengths = [2_003] * 20 + [rng.randint(257, 2_500) for _ in range(40)]
    rows = pack(store([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string"), buckets=4).collect()
    edges = sorted(set(lengths))
    counts = [lengths.count(e) for e in edges]
    assert sorted(r.n_tokens for r in rows) == sorted(lengths)
    assert sum(r.padding for r in rows) == plain_boundaries(edges, counts, 4) - sum(lengths)
    assert {r.bucket_len for r in rows} <= set(lengths)
    assert {r.padding for r in pack(store([(i, "w " * 20_020) for i in range(5)], "doc_id long, text string")).collect()} == {0}
