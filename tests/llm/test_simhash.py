import random

import numpy as np
import pytest
import xxhash

from rivulet.llm.components import components
from rivulet.llm.simhash import fingerprint_of, group_count, near_links, op2_simhash, simhash_dedup


def brute_fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(points, bits):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_fingerprints():
    for text in ("", None, "one", "A b c", "Das Haus ist GROSS und  alt", "x\x0by\x0cz\tq r s t u", "nb sp and   em é É"):
        assert fingerprint_of(text) == brute_fingerprint(text)


def test_matches_brute_force(spark, sf_dir, documents):
    prints = {i: brute_fingerprint(t) for i, t, _ in documents}
    roots = brute_classes(set(prints.values()), 4)
    least = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_groups_follow_the_number_of_points():
    assert [group_count(n, 4, 2) for n in (10, 10**5, 10**7, 10**9)] == sorted(group_count(n, 4, 2) for n in (10, 10**5, 10**7, 10**9))
    assert group_count(10, 4, 2) == 5 < group_count(10**9, 4, 2)


@pytest.mark.parametrize("width, groups", [(2, 5), (2, 7), (1, 6), (4, 5), (3, 8)])
def test_links_of_dense_points(spark, width, groups):
    """Clusters of near points, cut into many blocks: the same classes as by brute force, whatever the grid."""
    rng = random.Random(5)
    points = set()
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(60):
            points.add(p)
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
    signed = np.array(sorted(points), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = near_links(df, width=width, block=16, groups=groups)
    found = {r.node: r.root for r in components(links).collect()}
    want = brute_classes(points, 4)
    by_want, by_found = {}, {}
    for u, s in zip(sorted(points), signed):
        by_want.setdefault(want[u], set()).add(s)
        by_found.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_found.values()))
    assert links.count() < 70 * 24 * len(points)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(odd):
    got = simhash_dedup(odd).collect()
    assert len(got) == 10
    same = [r for r in got if r.fingerprint == f"{brute_fingerprint('same words here in this text now'):016x}"]
    assert len(same) == 4 and {r.component_id for r in same} == {1} and sum(r.kept for r in same) == 1
    wordless = [r for r in got if r.doc_id in (3, 4, 5)]
    assert {r.fingerprint for r in wordless} == {"0" * 16} and {r.component_id for r in wordless} == {3}


def test_empty_table(none):
    assert simhash_dedup(none).collect() == []
