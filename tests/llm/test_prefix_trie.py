import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from rivulet.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    """The nodes of rows ``(conv_id, turn, role, text)``, by hand."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h, source = zlib.crc32(str(c).encode()) % 6, c - int(c / 100) * 100
        built[c] = tuple(own.get(c - source, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids),
            sum(not any(len(q) > len(p) and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), sha(",".join(map(str, sorted(c for c in members if built[c] == path)))),
        ))
    return sorted(out, key=str)


def result(spark, store, rows, extra=False):
    table = store(rows, SCHEMA)
    if extra:
        table = table.withColumn("h", F.lit("mine")).withColumn("path", F.lit(3)).withColumn("digest", F.lit(None)).withColumn("p", F.lit(1))
    turns = T.stored(T.numbered_turns(table), "trie-turns")
    return sorted((tuple(r) for r in T.prefix_trie(T.rebuilt_turns(turns), turns.where("p = 1")).select(*COLUMNS).collect()), key=str)


def test_matches_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = T.op13_prefix_trie(spark, sf_dir)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({T.OP13_SQL})").fetchall()))


def test_odd_rows(spark, store):
    """Null ids, turns, roles and texts, ties, repeated rows, negative ids, sources that are missing, conversations left without a turn."""
    rows = [(c, t, "user" if t % 2 == 0 else None, f"é{t}" * (c % 3)) for c in range(96, 130) for t in range(1 + c % 7)]
    rows += [(0, None, "a", "x"), (0, None, "a", "x"), (0, None, None, None), (0, 2, "b", ""), (None, 1, "a", "x"), (7, 1, "a", "x"), (-5, 0, "a", "x"), (-5, 1, "b", "y"), (-5, 1, "b", "z"), (-205, 3, "user", "q" * 200_000)]
    assert result(spark, store, rows) == brute(rows)
    assert result(spark, store, rows, extra=True) == brute(rows)


def test_long_conversations_cross_blocks(spark, store):
    """Copies and forks at, before and behind the edges of blocks."""
    same = [("u", f"turn {i}") for i in range(27)]
    rows = []
    for c, (n, fork) in enumerate([(27, 99), (27, 99), (16, 99), (17, 99), (24, 99), (27, 8), (27, 9), (27, 16), (27, 17), (8, 99), (9, 99), (1, 99)]):
        rows += [(1000 + c, i, r, t if i < fork else f"{t} of {c}") for i, (r, t) in enumerate(same[:n])]
    assert result(spark, store, rows) == brute(rows)


def test_a_path_of_many_conversations(spark, store):
    """More members and children of one node than a range of ids or a hub's share."""
    rows = [(c, 0, "u", "hello") for c in range(9000)] + [(c, 1, "u", f"{c}") for c in range(0, 9000, 7)]
    turns = T.stored(T.numbered_turns(store(rows, SCHEMA)), "trie-turns").withColumn("part", F.lit(0))
    got = {(r.conv_id, r.depth): r for r in T.prefix_trie(turns, turns).collect()}
    top, first = got[0, 0], got[0, 1]
    kids = [r for (_, d), r in got.items() if d == 2]
    assert (top.n_convs, top.n_children, first.n_convs, first.n_children, first.n_leaves) == (9000, 1, 9000, len(kids), len(kids))
    assert {r.parent_conv_id for r in kids} == {0} and len(kids) == len(range(0, 9000, 7))
    assert first.saved_tokens == top.saved_tokens == 8999 * 5
    assert first.ends_sha256 == sha(",".join(str(c) for c in range(9000) if c % 7))


def test_empty_table(spark, store):
    assert result(spark, store, []) == result(spark, store, [(None, 1, "a", "b")]) == []


def test_only_turnless_conversations(spark, store):
    turns = store([], "conv_id long, part int, p int, digest binary, n long")
    got = T.prefix_trie(turns, store([(4,), (9,)], "conv_id long")).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(4, 0, None, 2, 0, 1, 0, sha("4,9"))]
