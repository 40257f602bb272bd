"""A Merkle manifest of a dataset, with proofs by pointer jumping.

The leaves of a group (a language) are numbered in the order of their ids;
eight consecutive nodes make a run, whose hash is a node of the next level,
until one node is left.  The groups' last nodes, in the order of the groups,
are the leaves of one more tree of the same kind.

A run's node holds the segment of siblings that leads to its parent.
Repeated self-joins of the runs double the distance to the ancestor that a
segment reaches and concatenate the segments, so all reach the root after
log2(height) rounds; a leaf then takes over the segment of its own run.
Runs are a seventh as many as leaves, and the long segments cross the network
once a run, not once a leaf.

An ancestor that many runs point to is dealt over as many salts as it has
descendants in blocks of 64, so no task gets all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.indexing import index_within_groups
from rivulet.llm.common import CRC_SQL, crc_sql, fresh, read_table, stored, with_row

FAN = 8
#: Descendants of one ancestor that share a salt in a self-join.
TOGETHER = 64
#: The tree of the groups' roots; the groups' own trees count from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(value: Column) -> Column:
    """A field of a leaf: its bytes' count, a colon and its text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_hash(df: DataFrame, names: tuple[str, ...], **instead: Column) -> Column:
    return digest(F.concat(*[field(instead.get(c, F.col(c))) for c in names]))


def _run_digest(kids: Column) -> Column:
    return digest(F.array_join(F.transform(kids, hexed), ""))


def _levels(nodes: int) -> list[int]:
    """Number of nodes on each level above one of ``nodes`` nodes."""
    out = []
    while nodes > 1:
        nodes = -(-nodes // FAN)
        out.append(nodes)
    return out


def _runs_above(nodes: DataFrame, largest: int, label: str) -> list[DataFrame]:
    """Per level the stored runs ``tree, level, idx, n, kids, hash`` above ``nodes(tree, idx, n, hash)``.

    ``n`` is how many nodes the tree has on the level; a tree ends at one.
    ``largest`` is the greatest ``n``, so the loop runs once a level.
    """
    out = []
    for level in range(1, len(_levels(largest)) + 1):
        runs = (
            nodes.where("n > 1")
            .groupBy("tree", F.expr(f"idx div {FAN}").alias("at"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"), F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"))
            .select("tree", F.lit(level).alias("level"), F.col("at").alias("idx"), "n", F.col("kids.hash").alias("kids"))
        )
        runs = stored(runs.withColumn("hash", _run_digest(F.col("kids"))), f"merkle-{label}")
        out.append(runs)
        nodes = runs
    return out


def _siblings(kids: Column, at: Column) -> Column:
    """The step from kid number ``at`` to its run: the hashes before it and behind it."""
    before = F.slice(kids, F.lit(1), at)
    behind = F.slice(kids, at + 2, F.lit(FAN))
    return F.struct(before.alias("before"), behind.alias("behind"))


def _child_key(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.cast("int").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def jump(links: DataFrame, height: int) -> DataFrame:
    """``node, steps`` for all ``links(node, parent, step)``: the steps from each node up to the root.

    Each round joins the links with themselves: a node whose ancestor has a
    segment of its own takes it over, so segments reach 1, 2, 4 ... levels up.
    ``height`` bounds the number of levels.
    """
    held = stored(links.select("node", F.col("parent").alias("anc"), F.array("step").alias("steps")), "merkle-jump")
    reach = 1
    while reach < height:
        # An ancestor ``reach`` levels up has at most FAN ** reach descendants that point to it.
        salts = max(1, min(FAN**reach, held.count()) // TOGETHER)
        above = held.select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("steps").alias("more"))
        # Only nodes that are an ancestor now are copied for the salts.
        above = above.join(held.select("anc").distinct(), "anc", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = held.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
        held = stored(
            salted.join(above, ["anc", "salt"], "left").select(
                "node", F.coalesce("far", "anc").alias("anc"), F.when(F.col("more").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps")
            ),
            "merkle-jump",
        )
        reach *= 2
    return held.select("node", "steps")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
    tampered: Column | None = None, text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``_row, doc_id, leaf, subroot, root, proof, folded_root, verified``.

    ``proof`` is the array of steps from the leaf to the root, each the hex
    hashes ``before`` and ``behind`` the node in its run.  ``folded_root`` is
    recomputed from that proof and the leaf, which is taken from the row as it
    is now: where ``tampered`` holds, with the letters A-Z of ``text_col``
    lower-cased.  ``verified`` is whether it equals the root.

    A null field is ``-`` in the leaf.  Within a group, leaves are in the
    order of the id (null first), equal ids in the order of their leaves, so
    repeated rows have equal leaves side by side; the null group comes first.
    A single leaf is its own root, with an empty proof.  Texts of any length
    are hashed whole.  An empty table gives an empty result.  Other columns
    of ``docs`` are not read.
    """
    names = list(dict.fromkeys([*fields, id_col, group_col]))
    row = fresh(docs, "_row")
    rows = with_row(docs.select(*names), row)
    now = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = rows.select(
        F.col(row).alias("_row"), F.col(id_col).alias("doc_id"), F.col(group_col).alias("grp"), leaf_hash(rows, fields).alias("hash"),
        F.when(now, leaf_hash(rows, fields, **{text_col: ascii_lower(F.col(text_col))})).alias("now"),
    )
    rows = rows.withColumn("first", F.col("grp").isNotNull())
    placed = stored(index_within_groups(stored(rows, "merkle-leaves"), ["first", "grp"], ["doc_id", "hash", "_row"], "idx"), "merkle-leaves")

    # A row a group: its number in the order of the groups, and its size.
    sizes = placed.groupBy("first", "grp").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(index_within_groups(sizes, [], ["first", "grp"], "tree"), "merkle-groups")
    found = groups.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("n")).first()
    if not found["groups"]:
        schema = "_row long, doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", leaf string, subroot string, root string, proof array<struct<before:array<string>,behind:array<string>>>, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], schema)
    same = placed["first"].eqNullSafe(groups["first"]) & placed["grp"].eqNullSafe(groups["grp"])
    leaves = placed.join(groups, same).select("_row", "doc_id", "hash", "now", "idx", F.col("tree").cast("int").alias("tree"), "n")
    leaves = stored(leaves, "merkle-leaves")

    runs = _runs_above(leaves.select("tree", "idx", "n", "hash"), found["n"], "runs")
    ends = [leaves.where("n = 1").select("tree", F.lit(0).alias("level"), "hash")]
    ends += [r.where("n = 1").select("tree", "level", "hash") for r in runs]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    subroots = stored(subroots, "merkle-subroots")
    tops = _runs_above(
        subroots.select(F.lit(TOP).alias("tree"), F.col("tree").cast("long").alias("idx"), F.lit(found["groups"]).cast("long").alias("n"), "hash"),
        found["groups"], "top",
    )
    every = runs + tops
    root = (tops[-1] if tops else subroots).select(F.col("hash").alias("root_hash"))

    # The link of every run to the run above it; a group's last node continues in the top tree.
    links = None
    for r in [*runs[1:], *tops[1:]]:
        at = r.select(F.col("tree"), "level", F.posexplode("kids").alias("at", "kid"), "idx", "kids")
        part = at.select(
            _child_key(F.col("tree"), F.col("level") - 1, F.col("idx") * FAN + F.col("at")).alias("node"),
            _child_key(F.col("tree"), F.col("level"), F.col("idx")).alias("parent"), _siblings(F.col("kids"), F.col("at")).alias("step"),
        )
        links = part if links is None else links.unionByName(part)
    if tops:
        at = tops[0].select("level", F.posexplode("kids").alias("at", "kid"), "idx", "kids")
        part = at.select(
            (F.col("idx") * FAN + F.col("at")).cast("int").alias("tree"), _child_key(F.lit(TOP), F.col("level"), F.col("idx")).alias("parent"),
            _siblings(F.col("kids"), F.col("at")).alias("step"),
        ).join(subroots.where("level > 0").select("tree", F.col("level").alias("end")), "tree")
        part = part.select(_child_key(F.col("tree"), F.col("end"), F.lit(0)).alias("node"), "parent", "step")
        links = part if links is None else links.unionByName(part)

    height = len(runs) + len(tops)
    own = None
    for r in every:
        part = r.select(_child_key(F.col("tree"), F.col("level"), F.col("idx")).alias("run"), "kids")
        own = part if own is None else own.unionByName(part)
    none = "array<struct<before:array<binary>,behind:array<binary>>>"
    if own is None:  # one leaf in all
        out = leaves.select("*", F.array().cast(none).alias("proof"))
    else:
        if links is not None:
            steps = jump(links, height)
            own = own.join(steps.select(F.col("node").alias("run"), "steps"), "run", "left").withColumn("steps", F.coalesce("steps", F.array().cast(none)))
        else:
            own = own.withColumn("steps", F.array().cast(none))
        up = F.when(F.col("n") > 1, _child_key(F.col("tree"), F.lit(1), F.expr(f"idx div {FAN}")))
        up = up.otherwise(_child_key(F.lit(TOP), F.lit(1), F.expr(f"tree div {FAN}")))
        at = F.when(F.col("n") > 1, F.col("idx") % FAN).otherwise(F.col("tree") % FAN).cast("int")
        first = F.array(_siblings(F.col("kids"), at))
        out = leaves.withColumn("run", up).join(own, "run", "left")
        out = out.withColumn("proof", F.when(F.col("kids").isNull(), F.array().cast(none)).otherwise(F.concat(first, F.col("steps"))))
    out = out.join(subroots.select("tree", F.col("hash").alias("sub")), "tree")
    out = out.withColumn("root", hexed(root.scalar()))
    proof = F.transform("proof", lambda s: F.struct(F.transform(s["before"], hexed).alias("before"), F.transform(s["behind"], hexed).alias("behind")))
    out = out.withColumn("proof", proof)
    fold = F.aggregate("proof", hexed(F.coalesce("now", "hash")), lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["behind"], "")).cast("binary"), 256))
    out = out.withColumn("folded_root", fold)
    return out.select("_row", "doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("sub")).alias("subroot"), "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_sha256(proof: Column) -> Column:
    """One hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(F.array_join(s["before"], ""), F.array_join(s["behind"], ""))), "").cast("binary"), 256)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language; where 3 divides crc32 of the id, a document was tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest(docs, tampered=changed)
    return out.select("doc_id", "leaf", "subroot", "root", proof_sha256(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
f AS (
  SELECT doc_id, lang, text, crc32 % 3 = 0 AS changed,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM documents, LATERAL (SELECT {crc_sql("doc_id::VARCHAR")} AS crc32 FROM crc_table) c
),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN changed THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS now
  FROM f
),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM l
),
grown(tree, level, idx, n, hash) AS (
  SELECT tree, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM grown WHERE n > 1 GROUP BY tree, level, idx // 8, n
),
subroots AS (SELECT tree, hash AS subroot, count(*) OVER () AS n FROM grown WHERE n = 1),
top(level, idx, n, hash) AS (
  SELECT 0, tree, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 8, n
),
nodes AS (SELECT tree, level, idx, n, hash FROM grown UNION ALL SELECT -1, level, idx, n, hash FROM top),
runs AS (SELECT tree, level, idx // 8 AS run, list(hash ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY ALL),
climb(doc, own, tree, level, idx, n, proof, folded) AS (
  SELECT row_number() OVER (), tree, tree, 0, idx, n, '', coalesce(now, leaf) FROM (SELECT * FROM leaves ORDER BY tree, idx)
  UNION ALL
  SELECT doc, own, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
         CASE WHEN c.n = 1 THEN own ELSE idx // 8 END, CASE WHEN c.n = 1 THEN (SELECT max(n) FROM subroots) ELSE (c.n + 7) // 8 END,
         CASE WHEN c.n = 1 THEN proof ELSE proof || list_aggregate(list_concat(kids[1 : idx % 8], kids[idx % 8 + 2 : 8], ['']), 'string_agg', '') END,
         CASE WHEN c.n = 1 THEN folded ELSE sha256(list_aggregate(list_concat(kids[1 : idx % 8], [folded], kids[idx % 8 + 2 : 8]), 'string_agg', '')) END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.idx // 8
  WHERE c.n > 1 OR c.tree >= 0
),
numbered AS (SELECT row_number() OVER () AS doc, * FROM (SELECT * FROM leaves ORDER BY tree, idx)),
root AS (SELECT hash AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM numbered JOIN subroots USING (tree) JOIN climb ON climb.doc = numbered.doc AND climb.tree = -1 AND climb.n = 1, root
"""
