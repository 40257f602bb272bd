"""Rule trees as tables.

A rule is either *single* -- a key and an ordered list of (name, value)
factors -- or *multi* -- a key and an ordered list of child rules.  We hold
them as three tables:

    rules    (rule_id string, kind 'single'|'multi', key int)
    factors  (rule_id, pos int, name string, vtype string, value string)
    children (parent_id, pos long, child_id)

Keys: -1 marks a one-factor single rule (never a multi rule); for matching we
read 0 as ALL factors must hold and 1 as ANY factor may hold (our reading --
the key is otherwise uninterpreted).

Nothing is collected to the driver: tree walking doubles its paths in each
round of a loop (log2 of the depth), never over rows.  Which side of a join is broadcast is
left to the bytes that adaptive execution measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.session import ensure_checkpoint_dir

# Value types a factor may carry, and key meanings.
VTYPES = ("int", "str", "char", "float", "double")
KEY_ATOM, KEY_ALL, KEY_ANY = -1, 0, 1

# A value that holds more than one in PARTS of all field rows is dealt over copies of the rules' rows.
PARTS = 1000


def canonical_value(value: Column, vtype: Column) -> Column:
    """Comparable text of a typed value, with the reference's equality of boxed values.

    Numbers and characters compare by numeric value across types (an int 1,
    a float 1.0 and the character with code 1 are equal; a float 0.1 is not
    the double 0.1), text compares as text.  Integral values keep every
    digit; other numbers use their double form.  A value that is not of its
    type is equal only to the same text of the same type, and null only to null.
    """
    as_double = (F.when(vtype == "float", value.try_cast("float").cast("double"))
                 .otherwise(value.try_cast("double")))
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < F.lit(1e18))
    number = (F.when(vtype == "int", value.try_cast("bigint").cast("string"))
              .when(vtype == "char", F.ascii(value).cast("string"))
              .when(whole, as_double.cast("bigint").cast("string"))
              .otherwise(as_double.cast("string")))
    numeric = vtype.isin("int", "char", "float", "double")
    return F.when(numeric & number.isNull(), F.concat(F.lit("x:"), vtype, F.lit(":"), value)) \
        .when(numeric, F.concat(F.lit("n:"), number)).otherwise(F.concat(F.lit("s:"), value))


# --------------------------------------------------------------------- R2 signature
def signatures(rules: DataFrame, factors: DataFrame) -> DataFrame:
    """(rule_id, key, n_factors, signature) for single rules.

    The signature is the list of (name, comparable value) in position order,
    as a column of structs: nothing is joined to text, so separators in names
    or values mean nothing.  Two rules are equal exactly when their keys and
    signatures are.  The list is bounded by the rule's own size.
    """
    f = factors.select("rule_id", F.struct("pos", "name", canonical_value(F.col("value"), F.col("vtype")).alias("value")).alias("f"))
    per_rule = f.groupBy("rule_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    singles = rules.where(F.col("kind") == "single").select("rule_id", "key")
    atoms = F.transform("fs", lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return singles.join(per_rule, "rule_id", "left").select(
        "rule_id", "key", F.coalesce(F.size("fs"), F.lit(0)).cast("long").alias("n_factors"),
        F.when(F.col("fs").isNull(), none).otherwise(atoms).alias("signature"))


# --------------------------------------------------------------------- R1
def validate(rules: DataFrame, factors: DataFrame) -> DataFrame:
    """Rules breaking the invariants: key -1 needs fewer than 2 factors; a multi rule never has key -1."""
    counts = factors.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_factors"))
    r = rules.join(counts, "rule_id", "left").withColumn("n_factors", F.coalesce("n_factors", F.lit(0)))
    reason = (F.when((F.col("kind") == "single") & (F.col("key") == KEY_ATOM) & (F.col("n_factors") >= 2),
                     F.lit("key -1 with 2 or more factors"))
              .when((F.col("kind") == "multi") & (F.col("key") == KEY_ATOM), F.lit("multi rule with key -1")))
    return r.select("rule_id", "kind", "key", "n_factors", reason.alias("reason")).where(F.col("reason").isNotNull())


# --------------------------------------------------------------------- R2
def equality_classes(rules: DataFrame, factors: DataFrame) -> DataFrame:
    """Each single rule with the smallest rule id of its equality class and the class size.

    Signatures are built once (checkpointed), aggregated per class (partial
    aggregation absorbs a hot class), and joined back; no pairs are formed.
    A null key is a key like any other.
    """
    ensure_checkpoint_dir(rules.sparkSession)
    sig = signatures(rules, factors).select("rule_id", F.struct(F.col("key").isNull(), F.coalesce("key", F.lit(0)), "signature").alias("is")).checkpoint()
    classes = sig.groupBy("is").agg(F.min("rule_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return sig.join(classes, [sig["is"].eqNullSafe(classes["is"])]).select("rule_id", "class_id", "class_size")


# --------------------------------------------------------------------- R3
def check_tree(rules: DataFrame, children: DataFrame) -> None:
    """Raises unless every child and parent is a rule and no multi rule is below itself, reachable or not.

    Cycles are found by pointer jumping: round k holds the pairs of a multi
    rule and its ancestors exactly 2^k levels up.  They run out once 2^k is
    past the depth; only a cycle goes on beyond the number of multi rules.
    """
    names = children.select(F.col("parent_id").alias("rule_id")).unionByName(children.select(F.col("child_id").alias("rule_id"))).distinct()
    unknown = names.join(rules, "rule_id", "left_anti").limit(3).collect()
    if unknown:
        raise ValueError(f"children name unknown rules: {', '.join(str(r['rule_id']) for r in unknown)}")
    multi = rules.where(F.col("kind") == "multi").select("rule_id").distinct()
    pairs = (children.select(F.col("child_id").alias("node"), F.col("parent_id").alias("anc")).distinct()
             .join(multi.withColumnRenamed("rule_id", "node"), "node").checkpoint())
    bound, reach = multi.count(), 1
    while not pairs.isEmpty():
        if reach > bound:
            raise ValueError("rule tree has a cycle")
        up = pairs.select(F.col("node").alias("anc"), F.col("anc").alias("far"))
        pairs = pairs.join(up, "anc").select("node", F.col("far").alias("anc")).distinct().checkpoint()
        reach *= 2


def flatten(rules: DataFrame, children: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Leaf (single) rules under each root, depth first.

    Returns (root_id, leaf_id, depth, path); ``path`` is the array of child
    positions, so sorting by it gives depth-first order, repeats kept.  A
    single rule as root is its own leaf, with an empty path.  By default the
    rules that are nobody's child are the roots.  A rule may stand below
    several parents, and a root below another.  A child or parent that is no
    rule, and any cycle of rules, is an error (:func:`check_tree`).

    Paths of the multi rules (the inner nodes, few next to the leaves) grow by
    pointer jumping: each round every path that has not come to a root yet
    takes over the paths of the node it has reached, so it doubles, and a
    tree of depth d needs log2(d) rounds, each one join and a checkpoint.  The
    leaves are then attached in a single join with the child table.  Paths
    exist for as many nodes as the multi rules occur below the roots.
    """
    ensure_checkpoint_dir(rules.sparkSession)
    check_tree(rules, children)
    kinds = rules.select(F.col("rule_id").alias("child_id"), F.col("kind"))
    edges = children.select("parent_id", F.col("pos").cast("bigint").alias("pos"), "child_id").join(kinds, "child_id")
    if roots is None:
        roots = rules.select("rule_id").join(children.select(F.col("child_id").alias("rule_id")), "rule_id", "left_anti")
    roots = roots.select("rule_id").join(rules.select("rule_id", "kind"), "rule_id").checkpoint()
    no_path, no_node = F.array().cast("array<bigint>"), F.lit(None).cast("string")
    # A path leads up from ``node`` to ``anc``, or has come to ``root_id``; a root's own path is empty.
    start = roots.where(F.col("kind") == "multi").select(
        F.col("rule_id").alias("node"), no_node.alias("anc"), F.col("rule_id").alias("root_id"), no_path.alias("path"))
    steps = edges.where(F.col("kind") == "multi").select(
        F.col("child_id").alias("node"), F.col("parent_id").alias("anc"), no_node.alias("root_id"), F.array("pos").alias("path"))
    paths = start.unionByName(steps).checkpoint()
    while not (going := paths.where("anc IS NOT NULL")).isEmpty():
        above = paths.select(F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("root_id").alias("top"), F.col("path").alias("more"))
        longer = going.join(above, "anc").select(
            "node", F.col("far").alias("anc"), F.col("top").alias("root_id"), F.concat("more", "path").alias("path"))
        paths = paths.where("anc IS NULL").unionByName(longer).checkpoint()
    nodes = paths.select("root_id", F.col("node").alias("parent_id"), "path")
    below = edges.where(F.col("kind") == "single").join(nodes, "parent_id").select(
        "root_id", F.col("child_id").alias("leaf_id"), (F.size("path") + 1).alias("depth"),
        F.concat("path", F.array("pos")).alias("path"))
    alone = roots.where(F.col("kind") == "single").select(
        F.col("rule_id").alias("root_id"), F.col("rule_id").alias("leaf_id"), F.lit(0).alias("depth"), no_path.alias("path"))
    return below.unionByName(alone)


# --------------------------------------------------------------------- R4
def distinct_leaves(flat: DataFrame, sigs: DataFrame) -> DataFrame:
    """Leaves de-duplicated by value (key and factors) under each root, first occurrence kept.

    Returns (root_id, leaf_id, first_path, n_occurrences).
    """
    j = flat.join(sigs.select(F.col("rule_id").alias("leaf_id"), "key", "signature"), "leaf_id")
    first = F.min(F.struct("path", "leaf_id"))
    out = j.groupBy("root_id", "key", "signature").agg(first.alias("first"), F.count(F.lit(1)).alias("n_occurrences"))
    return out.select("root_id", "first.leaf_id", F.col("first.path").alias("first_path"), "n_occurrences")


# --------------------------------------------------------------------- R5 / R6
def unpivot_records(df: DataFrame, id_col: str, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    """Records as (record_id, name, value, canon, fields): one row per field (a record seen as a map).

    ``canon`` is the comparable form of the typed value (:func:`canonical_value`).
    ``fields`` is the whole record as a map name -> canon; it stands on the
    record's first row only, and is null on the others.  Ids must be unique.
    """
    entries = F.array(*[
        F.struct(F.lit(name).alias("name"), col.cast("string").alias("value"),
                 canonical_value(col.cast("string"), F.lit(vtype)).alias("canon"))
        for name, (col, vtype) in fields.items()])
    whole = df.select(F.col(id_col).alias("record_id"), entries.alias("fs"))
    as_map = F.map_from_entries(F.transform("fs", lambda f: F.struct(f["name"], f["canon"])))
    return (whole.select("record_id", "fs", F.posexplode("fs").alias("at", "f"))
            .select("record_id", "f.name", "f.value", "f.canon", F.when(F.col("at") == 0, as_map).alias("fields")))


def _frequencies(records: DataFrame) -> DataFrame:
    """(name, canon, n): how often each value occurs among the records' fields."""
    return records.groupBy("name", "canon").agg(F.count(F.lit(1)).alias("n"))


def _dealt_join(records: DataFrame, rules: DataFrame, often: DataFrame) -> DataFrame:
    """Join on (name, canon); a value that many records share is dealt over copies of the rules' rows.

    The number of copies follows from the counts: one for each 1/``PARTS`` of
    all field rows that have the value, so no part of it is larger than that.
    Fewer than ``PARTS`` values can be so frequent, whatever the size of the
    data; only these are broadcast.
    """
    total = often.agg(F.sum("n").alias("t")).select("t").scalar()
    hot = F.broadcast(often.where(F.col("n") * PARTS > total).select("name", "canon", F.ceil(F.col("n") * PARTS / total).cast("int").alias("copies")))
    left = records.join(hot, ["name", "canon"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("record_id"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    right = rules.join(hot, ["name", "canon"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return left.join(right, ["name", "canon", "salt"]).drop("salt")


def match_atoms(records: DataFrame, atoms: DataFrame) -> DataFrame:
    """Records whose field ``name`` equals an atom's value: (name, value, record_id)."""
    a = atoms.select("name", F.col("value").alias("atom_value"),
                     canonical_value(F.col("value"), F.col("vtype")).alias("canon")).distinct()
    return _dealt_join(records.select("record_id", "name", "canon"), a, _frequencies(records)).select(
        "name", F.col("atom_value").alias("value"), "record_id")


def match_rules(records: DataFrame, rules: DataFrame, factors: DataFrame) -> DataFrame:
    """(rule_id, record_id) for every record a single rule matches.

    key 0 or -1: every factor must hold; key 1: at least one.  A rule that
    needs all its factors meets the records only on its rarest one among the
    records, by id alone; the records it meets are then joined with their
    maps, where the other factors are looked up, so hits are final and nothing
    is counted.  A rule that needs one takes the distinct hits.
    Factors without a value match nothing.
    """
    f = factors.select("rule_id", "pos", "name", canonical_value(F.col("value"), F.col("vtype")).alias("canon"))
    f = f.join(rules.where(F.col("kind") == "single").select("rule_id", "key"), "rule_id")
    any_of = f.where(F.col("key") == KEY_ANY).select("rule_id", "name", "canon").distinct()
    often = _frequencies(records)
    seen = records.select("record_id", "name", "canon")
    hit = _dealt_join(seen, any_of, often).select("rule_id", "record_id").distinct()

    all_of = f.where(F.col("key").isNull() | (F.col("key") != KEY_ANY))
    ranked = all_of.join(often, ["name", "canon"], "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "name", "canon")).alias("rare"),
        F.collect_set(F.struct("name", F.coalesce("canon", F.lit("")).alias("canon"))).alias("wanted"))
    rarest = ranked.where("rare.n > 0").select("rule_id", "rare.name", "rare.canon", "wanted")
    met = _dealt_join(seen, rarest, often).select("rule_id", "record_id", "wanted")
    met = met.join(records.where("fields IS NOT NULL").select("record_id", "fields"), "record_id")
    holds = F.forall("wanted", lambda w: F.coalesce(F.get(F.filter(F.map_entries("fields"), lambda e: e["key"] == w["name"]), 0)["value"] == w["canon"], F.lit(False)))
    return hit.unionByName(met.where(holds).select("rule_id", "record_id"))
