"""A prefix trie of conversations by truncation peeling.

Every turn gets a digest of its role and text, and every prefix of a
conversation the hash of its digests, so equal prefixes have equal hashes.
The trie is then peeled from its deepest level up: the nodes that are left,
stripped of their last turn, meet the conversations that end at this depth;
those with one path are merged into a node, whose counts are complete as soon
as it is found.  Conversations are not spread over all their prefixes: where
they share one, a single row goes on for all of them.

A row carries the path of one block of eight depths at a time, so the rows of
a long conversation stay short.  The levels of a block are chained in one
job, whose nodes are stored; there is one job for eight turns of the longest
path that two conversations share.  Merging sums and minima is done before the shuffle, so a path
that a third of all conversations share costs a task no more than others.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.common import CRC_SQL, crc_sql, read_table, stored
from rivulet.session import work_dir

#: Depths in a block.
BLOCK = 8
#: A node with more than this share of all nodes as children is a hub; there are at most so many, so they are broadcast.
HUB_SHARE = 1000
#: The ids that end at a node are listed in ranges of 2 ** this many ids.
RANGE = 12
#: Hash of the empty path.
ROOT = b""

_CHAINS = "conv_id bigint, depth int, ends boolean, block int, path array<struct<h:binary,n:bigint>>"
_NODES = "conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, depth int, h binary, above binary"


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn's role and text, each with its length before it."""
    parts = [x for y in (role, text) for x in (F.octet_length(y).cast("string"), F.lit(":"), y)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, p, digest, n``: the turns of each conversation from 1, in the order of turn (null first), role and digest.

    Rows with a null id belong to no conversation; a null role or text is
    empty.  ``n`` is the number of code points of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("n")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("p"), "digest", "n")


def rebuilt_turns(turns: DataFrame, most: int = 6) -> DataFrame:
    """``conv_id, part, p, digest, n``: the first h turns of conversation c - c % 100, then c's own after its first h; h = crc32(c) % ``most``.

    Conversations that have no turn then are not in it.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("p") > h).select("conv_id", F.lit(1).alias("part"), "p", "digest", "n")
    # At most 199 conversations share a source, and each takes fewer than ``most`` of its turns.
    asking = turns.where("p = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("source"), h.alias("h"))
    source = turns.where((F.col("p") < most) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("source"), "p", "digest", "n")
    lent = asking.join(source, "source").where("p <= h").select("conv_id", F.lit(0).alias("part"), "p", "digest", "n")
    return own.unionByName(lent)


def _chain(batches):
    """The hash of every prefix, a row per block of depths; turns come conversation by conversation, in order."""
    conv, depth, path, out = None, 0, [], []
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.struct([("h", pa.binary()), ("n", pa.int64())]))]

    def emit() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "ends", "block", "path"])

    for b in batches:
        for c, digest, n in zip(b["conv_id"].to_pylist(), b["digest"].to_pylist(), b["n"].to_pylist()):
            if c != conv:
                if conv is not None:
                    out.append((conv, depth, True, (depth - 1) // BLOCK, path))
                conv, depth, path = c, 0, [{"h": ROOT, "n": 0}]
            elif len(path) > BLOCK:
                # The path of the next block starts with the prefix before it.
                out.append((conv, depth, False, (depth - 1) // BLOCK, path))
                path = [path[-1]]
            depth += 1
            path.append({"h": hashlib.sha256(path[-1]["h"] + digest).digest(), "n": n})
        if len(out) >= 4096:
            yield emit()
    if conv is not None:
        out.append((conv, depth, True, (depth - 1) // BLOCK, path))
    if out:
        yield emit()


def chains(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, ends, block, path`` of ``turns(conv_id, part, p, digest, n)``, stored in folders by block.

    ``path`` has the prefix hash and text length of each depth of a block,
    after those of the prefix before the block; ``depth`` is its last depth,
    and ``ends`` whether the conversation ends there.  A conversation's turns
    pass one by one through a task that holds one block of them.
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "p").select("conv_id", "digest", "n")
    path = work_dir(turns.sparkSession, "trie-paths")
    rows.mapInArrow(_chain, _CHAINS).hint("rebalance", "block").write.partitionBy("block").parquet(path)
    return turns.sparkSession.read.schema(_CHAINS).parquet(path)


def peel(paths: DataFrame) -> DataFrame:
    """The nodes of depth 1 and more of stored ``chains``, with ``h``, the hash of their path, and ``above``, that of their parent's.

    Where a conversation shares no prefix with another from some block on,
    its turns meet nobody when they are stripped; all such tails are peeled
    in one step.  The blocks above, in which paths meet, follow one by one.
    """
    spark = paths.sparkSession
    out, zero, one = work_dir(spark, "trie-nodes"), F.lit(0).cast("long"), F.lit(1).cast("long")
    folder = lambda block: f"{out}/block={block}"
    firsts = paths.groupBy("block", F.element_at("path", 2)["h"].alias("h")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    firsts = stored(firsts.select("conv_id", "block", "n"), "trie-firsts")
    alone = firsts.where("n = 1").select("conv_id", "block")
    starts = stored(alone.groupBy("conv_id").agg(F.min("block").alias("start")), "trie-starts")
    tails = paths.join(alone, ["conv_id", "block"]).select("conv_id", "block", "path", "ends", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("at"))
    over = F.col("ends") & (F.col("at") == F.size("path") - 1)
    tails.select(
        "conv_id", one.alias("n_convs"), F.when(over, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        (F.col("block") * BLOCK + F.col("at")).cast("int").alias("depth"), F.get("path", "at")["h"].alias("h"), F.get("path", F.col("at") - 1)["h"].alias("above"),
    ).write.parquet(f"{out}/tails")

    deepest = firsts.where("n > 1").agg(F.max("block")).first()[0]
    deepest = -1 if deepest is None else deepest
    for block in range(deepest, -1, -1):
        here = paths.where(F.col("block") == block).join(alone.where(F.col("block") == block).select("conv_id"), "conv_id", "left_anti")
        ended = here.where("ends").select("depth", "conv_id", "path", one.alias("n_convs"), zero.alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
        # Nodes that the block below left; one member of each leads to its path in this block.
        left = starts.where(F.col("start") == block + 1).select("conv_id", one.alias("n_convs"), one.alias("n_leaves"), zero.alias("saved_tokens"))
        if block < deepest:
            below = spark.read.schema(_NODES).parquet(folder(block + 1)).where(F.col("depth") == (block + 1) * BLOCK + 1)
            left = left.unionByName(below.select(*left.columns))
        rising, levels = left.join(here.select("conv_id", "path"), "conv_id").select("conv_id", "path", "n_convs", one.alias("child"), "n_leaves", "saved_tokens"), []
        for at in range(BLOCK, 0, -1):
            rows = ended.where(F.col("depth") == block * BLOCK + at).drop("depth")
            rows = rows.unionByName(rising)
            merged = rows.groupBy("path").agg(
                F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
                F.greatest(F.sum("n_leaves"), one).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            )
            nodes = merged.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.element_at("path", -1)["n"])
            levels.append(nodes.withColumn("depth", F.lit(block * BLOCK + at)))
            rising = nodes.select("conv_id", F.slice("path", 1, at).alias("path"), "n_convs", one.alias("child"), "n_leaves", "saved_tokens")
        found = levels[0]
        for nodes in levels[1:]:
            found = found.unionByName(nodes)
        found = found.withColumn("h", F.element_at("path", -1)["h"]).withColumn("above", F.element_at("path", -2)["h"]).drop("path")
        found.write.parquet(folder(block))
    return spark.read.schema(_NODES).parquet(f"{out}/tails", *[folder(b) for b in range(deepest + 1)])


def _listed(batches):
    """SHA-256 of each key's texts, comma-joined; rows come key by key, in order."""
    key, state = None, None
    for b in batches:
        keys, hashes = [], []
        for h, ids in zip(b["h"].to_pylist(), b["ids"].to_pylist()):
            if h != key:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = h, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["h", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["h", "ends_sha256"])


def id_lists(ended: DataFrame) -> DataFrame:
    """``h, ends_sha256`` of ``ended(h, conv_id)``: the hash of the ids of each ``h`` in decimal, ascending, comma-joined.

    Ids are gathered in ranges of 4,096 ids; the ranges of a node pass through
    a task in order, which keeps the state of a hash and no list.
    """
    ranges = ended.groupBy("h", F.shiftright("conv_id", RANGE).alias("at")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ranges = ranges.select("h", "at", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return ranges.repartition("h").sortWithinPartitions("h", "at").select("h", "ids").mapInArrow(_listed, "h binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all ``conversations(conv_id)``, each with its ``turns(conv_id, part, p, digest, n)``.

    Columns ``conv_id`` (the smallest member), ``depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and ``h``, the
    hash of the path.  A conversation without turns ends at the root, whose
    parent is null.  Repeated conversations are members of the same nodes.
    Without any conversation the result is empty.
    """
    conversations = stored(conversations.select("conv_id").distinct(), "trie-conversations")
    paths = chains(turns)
    nodes = peel(paths)
    known = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    if not known["n"]:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, h binary")
    first = nodes.where("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()

    root = turns.sparkSession.createDataFrame([(known["conv_id"], known["n"], first["n"], first["leaves"] or 1, first["saved"] or 0, 0, bytearray(ROOT), None)], _NODES)
    counts = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "h")
    upper = nodes.where("depth < 2").select(*counts, F.when(F.col("depth") == 1, F.lit(known["conv_id"])).alias("parent_conv_id"))
    upper = upper.unionByName(root.select(*counts, F.lit(None).cast("long").alias("parent_conv_id")))
    # Below, a child finds its parent by hash; the children of a hub stay where they are.
    total = nodes.count()
    hubs = nodes.where(F.col("n_children") * HUB_SHARE > total).select(F.col("h").alias("above"), F.col("conv_id").alias("hub"))
    lower = nodes.where("depth > 1").join(F.broadcast(hubs), "above", "left")
    parents = nodes.where("n_children > 0").select(F.col("h").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    others = lower.where("hub IS NULL").join(parents, "above").select(*counts, "parent_conv_id")
    every = upper.unionByName(lower.where("hub IS NOT NULL").select(*counts, F.col("hub").alias("parent_conv_id"))).unionByName(others)

    turnless = conversations.join(paths.where("block = 0").select("conv_id"), "conv_id", "left_anti")
    ended = paths.where("ends").select(F.element_at("path", -1)["h"].alias("h"), "conv_id").unionByName(turnless.select(F.lit(ROOT).alias("h"), "conv_id"))
    out = every.join(id_lists(ended), "h", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "h",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(numbered_turns(read_table(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(rebuilt_turns(turns), turns.where("p = 1")).drop("h")


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
o AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || strlen(text) || ':' || text)) AS turns
  FROM t GROUP BY conv_id
),
c AS (SELECT conv_id, turns, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM o, crc_table),
r AS (
  SELECT a.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[1 : a.h] END, a.turns[a.h + 1 :]) AS turns
  FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 100
),
m AS (
  SELECT conv_id AS member, u.d AS depth, turns[1 : u.d] AS path, u.d = len(turns) AS ends FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) u
),
g AS (
  SELECT path, depth, min(member) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY path, depth
),
w AS (SELECT member, depth, conv_id FROM m JOIN g USING (path, depth)),
k AS (SELECT g.*, w.conv_id AS parent_conv_id FROM g LEFT JOIN w ON w.member = g.conv_id AND w.depth = g.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
full_ AS (
  SELECT k.*, coalesce(n_children, 0) AS n_children, CASE WHEN k.depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[k.depth]['text']) END AS saved
  FROM k LEFT JOIN kids USING (conv_id, depth)
),
sums AS (
  SELECT w.conv_id, w.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens
  FROM full_ f JOIN w ON w.member = f.conv_id AND w.depth <= f.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN sums USING (conv_id, depth)
"""
