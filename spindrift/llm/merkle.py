"""Merkle manifest of a table: trees over groups of rows, a tree over their roots, and a proof for each row.

A leaf is the SHA-256 of a row's fields. In each group the leaves are numbered in order, and while more than one node is
left, every `arity` consecutive nodes become one: each level equijoins its nodes with those at computed sibling
indices (the index XOR 1 where two nodes meet, else the index less the slot), and the rows of slot zero, which then hold
their siblings by slot, emit the parents. Levels are written tables. What is left of the groups is put in order and goes
through the same tree. Proofs come down again level by level: a node has its own siblings and its parent's proof.

Numbers need no group in one task: rows are range partitioned by group and order, numbered within their partition, and
the counts of the earlier partitions are added. The joins are by group and index, so a large group is spread like any
other; a node meets at most `arity` others. What the driver holds is one number of levels and one root.

Defined cases: a null field is `-`; a null group is a group and the first one; null ids come first; rows with equal
ids are ordered by their leaves, and equal rows each have a leaf; a group of one row has its leaf as root, and one group
of one row makes that leaf the root with an empty proof, whose SHA-256 is that of no bytes; an empty table gives an empty table;
other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, shuffle_partitions, stored

PART = "array<struct<before:string,after:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def group_key(group: Column) -> Column:
    """A text that is never null and orders as the group does by its bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Rows, stored, with their place `idx` in their group and the group's number of rows `n`."""
    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    # the number is that of the partition in its upper bits and the place there in the lower ones
    table = stored(dealt.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), name)
    counts = table.groupBy(group, "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("__rows").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select(group, "__part", "__first", before.alias("__before"), F.sum("__rows").over(by).alias("n")), f"{name}-counts")
    idx = F.col("__row") - F.col("__first") + F.col("__before")
    return table.join(few(counts), [group, "__part"]).withColumn("idx", idx).drop("__row", "__part", "__first", "__before")


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Slot-zero nodes (g, idx, n) with `run`, the digests of their run by slot.

    Every other node looks up the index of its run's first sibling, one equijoin for each slot. All joins share the key
    of the first, so slot zero is shuffled once and every other node once.
    """
    slot = F.pmod("idx", F.lit(arity))
    found = nodes.where(slot == 0).select("g", "idx", "n", F.col("digest").alias("d0"))
    for k in range(1, arity):
        first = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - F.lit(k)
        found = found.join(nodes.where(slot == k).select("g", first.alias("idx"), F.col("digest").alias(f"d{k}")), ["g", "idx"], "left")
    return found.select("g", "idx", "n", F.array_compact(F.array(*[f"d{k}" for k in range(arity)])).alias("run"))


def parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The next level (g, idx, n, digest, run) of the groups that have more than one node."""
    met = siblings(nodes.where("n > 1"), arity)
    return met.select("g", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).cast("long").alias("n"), sha(F.array_join("run", "")).alias("digest"), "run")


def grown(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """All levels of the trees over leaves (g, idx, n, digest), each of them stored; the first are the leaves."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        levels.append(stored(parents(levels[-1], arity), f"{name}-level"))
        most = -(-most // arity)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, digest) of the node that is left of each group."""
    found = None
    for level in levels:
        part = level.where("n = 1").select("g", "digest")
        found = part if found is None else found.unionByName(part)
    return found


def below(parent: DataFrame, nodes: DataFrame, arity: int, carried: Sequence[str]) -> DataFrame:
    """Nodes with the proof of each: its siblings before and behind it, then those of its parent (g, idx, run, proof)."""
    up = parent.select("g", F.col("idx").alias("__up"), F.col("run").alias("__run"), "proof", *carried)
    met = nodes.where("n > 1").withColumn("__up", F.floor(F.col("idx") / arity)).join(up, ["g", "__up"])
    slot = F.pmod("idx", F.lit(arity)).cast("int")
    own = F.struct(F.array_join(F.slice("__run", F.lit(1), slot), "").alias("before"), F.array_join(F.slice("__run", slot + 2, F.lit(arity)), "").alias("after"))
    return met.select(*nodes.columns, F.concat(F.array(own), "proof").cast(PART).alias("proof"), *carried)


def proofs(levels: list[DataFrame], top: DataFrame, arity: int, carried: Sequence[str], name: str) -> DataFrame:
    """The leaves with `proof` and the columns `carried` of top (g, proof, carried), which continues each group's proof."""
    above = None
    for i in reversed(range(len(levels))):
        level = levels[i]
        here = level.where("n = 1").join(top, "g")
        if above is not None:
            here = here.unionByName(below(above, level, arity, carried))
        above = stored(here, f"{name}-proofs") if i else here
    return above


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda d, s: sha(F.concat(s["before"], d, s["after"])))


def manifest(df: DataFrame, id_col: str, group_col: str, leaf_values: Sequence[Column], forged_values: Sequence[Column] | None = None, arity: int = 8) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    leaf_values: the fields of a leaf. forged_values: the fields that are folded with the original siblings in the end,
    where they are given; a row whose forged leaf differs from its own is not verified.
    """
    own = leaf(leaf_values)
    rows = df.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("id"), own.alias("digest"), (leaf(forged_values) if forged_values is not None else own).alias("forged"))
    # range partitioning reads its input twice: texts are hashed once, before it
    leaves = stored(numbered(stored(rows, "merkle-hashes"), "g", ["id", "digest"], "merkle-rows"), "merkle-leaves")
    levels = grown(leaves.select("g", "idx", "n", "digest"), arity, "merkle")
    # the roots of the groups are the leaves of one more tree, whose only group is the empty text
    subroots = tops(levels).select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
    subroots = stored(numbered(subroots, "g", ["group"], "merkle-subroots"), "merkle-tops")
    upper = grown(subroots.select("g", "idx", "n", "digest"), arity, "merkle-upper")
    root = tops(upper).select("digest").first()
    root = F.lit(root[0] if root else None).cast("string")
    none = tops(upper).select("g", F.array().cast(PART).alias("proof"))
    upper[0] = subroots
    top = proofs(upper, none, arity, [], "merkle-upper").select(F.col("group").alias("g"), "proof", F.col("digest").alias("subroot"))
    levels[0] = leaves
    done = proofs([level if i == 0 else level.withColumnRenamed("digest", "node") for i, level in enumerate(levels)], stored(top, "merkle-top"), arity, ["subroot"], "merkle")
    text = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = done.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"), sha(text).alias("proof_sha256"), folded(F.col("forged"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
