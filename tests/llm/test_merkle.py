import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet.llm.merkle import OP11_SQL, jump, manifest, op11_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(last node, proof of every node as [(before, behind)])."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p - p % 8 : p - p % 8 + 8]
            proofs[i].append((run[: p % 8], run[p % 8 + 1 :]))
        place = [p // 8 for p in place]
        nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof hashes, folded root) of rows in the order of SCHEMA."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = mine, *climb([leaf(r) for r in mine])
    root, tops = climb([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        mine, sub, proofs = trees[lang]
        for r, proof in zip(mine, proofs):
            proof = proof + top
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = leaf((*r[:4], r[4].translate(lower)))
            for before, behind in proof:
                h = H("".join([*before, h, *behind]))
            out.append((r[0], leaf(r), sub, root, H("".join(x for b, a in proof for x in [*b, *a])), h, h == root))
    return sorted(out, key=str)


def result(docs):
    from rivulet.llm.merkle import proof_sha256

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = manifest(docs, tampered=changed).withColumn("p", proof_sha256(F.col("proof")))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.p, r.folded_root, r.verified) for r in got.collect()), key=str)


def test_matches_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = op11_merkle(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({OP11_SQL})").fetchall())


def test_many_groups_and_odd_rows(spark, store):
    """Null ids, groups and texts, repeated rows, lone leaves, and more groups than a run holds."""
    rows = [(i, "s", f"l{i % 3}" if i < 150 else f"Z{i}", i * 7, f"Text {i} É\n" * (i % 5)) for i in range(175)]
    rows += [(3, "s", "l0", 21, "Text 3 É\n" * 3), (3, "s", "l0", 21, "Text 3 É\n" * 3), (None, None, None, None, None), (None, "a", "l1", 1, "X"), (9001, "a", "", 1, ""), (9003, "a", "é", 1, "Y" * 300_000)]
    docs = store(rows, SCHEMA)
    assert result(docs) == brute(rows)
    clash = docs.withColumn("_row", F.lit("mine")).withColumn("hash", F.lit(1)).withColumn("tree", F.lit(None))
    assert result(clash) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_sizes_of_one_group(spark, store, n):
    rows = [(i, "s", None, i, f"T{i}") for i in range(n)]
    assert result(store(rows, SCHEMA)) == (brute(rows) if n else [])


def test_only_groups_of_one(spark, store):
    rows = [(i, "s", f"g{i:03}", i, "A") for i in range(70)]
    assert result(store(rows, SCHEMA)) == brute(rows)


def test_any_change_of_a_leaf_or_proof_fails(spark, store):
    docs = store([(i, "s", "en", i, "UPPER") for i in range(30)], SCHEMA)
    got = manifest(docs, tampered=F.col("doc_id") == 7)
    assert {r.doc_id for r in got.collect() if not r.verified} == {7}


def test_jumping_reaches_the_root_of_a_long_chain(spark):
    step = F.struct(F.array(F.col("id")).alias("before"), F.array().cast("array<long>").alias("behind"))
    links = spark.range(37).select(F.col("id").alias("node"), (F.col("id") + 1).alias("parent"), step.alias("step"))
    got = {r.node: [s.before[0] for s in r.steps] for r in jump(links, 37).collect()}
    assert got == {i: list(range(i, 37)) for i in range(37)}
