"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row.

Nodes carry the interval [low, high] of leaf ranks that they cover. A level's
buckets are the ranks without their last bits, so the ancestor of a node on a
level is the node of one bucket whose interval contains its own, and the
sibling is what the interval of the parent has besides it.

Levels are climbed in strata of STRATUM: a block holds the at most 2**STRATUM
nodes below one node of the next stratum, and its levels are built inside the
row. The blocks are stored, and proofs come down again by containment joins of
each stratum's blocks with the nodes of the stratum above. So leaves are
shuffled once for their ranks and once for their blocks, and everything above
is a 2**STRATUM-th of it; no group meets in one task. Only the number of levels
of the largest tree goes to the driver.

Leaves ascend by the ordering column, nulls first; ties are put in the order of
their digests, so repeated rows, which have equal digests, are leaves of their
own in any order. A null group is a group and comes first. A tree of one leaf is
that leaf. An empty table gives an empty result. Texts are hashed whole, in the
engine. Other columns of the input may have any names and are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import broadcast_if_small, checkpointed
from profseek.operators.numbering import number_all

#: Levels built inside one row.
STRATUM = 8
_LEVELS = "array<array<struct<low:bigint,high:bigint,digest:string>>>"
_PROOF = "array<struct<side:int,digest:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text; nulls as a dash."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, step: digest(
        F.when(step["side"] < 0, step["digest"]).otherwise(""), at,
        F.when(step["side"] > 0, step["digest"]).otherwise("")))


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["digest"]), ""), 256)


def _height(leaves: Column) -> Column:
    """Levels above that many leaves, two to a node."""
    return F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0)


def _levels(items: Column, height: Column) -> Column:
    """The nodes of a block by level; `items` are those of its lowest."""
    lowest = F.transform(items, lambda x: F.struct(x["rank"].alias("low"), x["rank"].alias("high"),
                                                   x["digest"].alias("digest")))

    def parent(below: Column, i: Column) -> Column:
        left, right = F.get(below, 2 * i), F.get(below, 2 * i + 1)
        return F.struct(left["low"].alias("low"), F.coalesce(right["high"], left["high"]).alias("high"),
                        digest(left["digest"], F.coalesce(right["digest"], F.lit(""))).alias("digest"))

    def one_more(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)
        places = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int"))
        return F.concat(levels, F.array(F.transform(places, lambda i: parent(below, i))))

    start = F.array(lowest).cast(_LEVELS)
    return F.when(height == 0, start).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), start, one_more))


def _siblings(levels: Column, height: Column, place: Column) -> Column:
    """Proof of the node at `place` in its block, up to the top of the block."""

    def step(level: Column) -> Column:
        row, bucket = F.get(levels, level), F.call_function("shiftright", place, level)
        above = F.get(F.get(levels, level + 1), F.call_function("shiftright", place, level + 1))
        here = F.get(row, bucket)
        before, after = here["low"] > above["low"], here["high"] < above["high"]  # what the parent covers besides
        return F.struct(
            F.when(before, -1).when(after, 1).otherwise(0).alias("side"),
            F.when(before, F.get(row, bucket - 1)["digest"]).when(after, F.get(row, bucket + 1)["digest"])
            .otherwise("").alias("digest"))

    none = F.array().cast(_PROOF)
    return F.when(height == 0, none).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), step).cast(_PROOF))


def _climbed(df: DataFrame, *order: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each stratum, lowest first, and the top (tree, digest) of every tree.

    `df` has tree, the columns of the order, digest and carried.
    """
    numbered = checkpointed(number_all(df, "tree", *order, name="ordinal"))
    trees = checkpointed(numbered.groupBy("tree").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
                         .select("tree", "first", _height(F.col("n")).alias("levels")))
    n, tallest = trees.agg(F.count(F.lit(1)), F.max("levels")).first()
    trees, tallest = broadcast_if_small(trees, n), tallest or 0
    heights = trees.drop("first")
    strata, level = [], numbered.join(trees, "tree").select(
        "tree", (F.col("ordinal") - F.col("first")).alias("rank"), "digest", "carried")
    for k in range(max(1, -(-tallest // STRATUM))):
        item = F.struct("rank", "digest", "carried")
        blocks = level.groupBy("tree", F.shiftright("rank", STRATUM).alias("block")).agg(
            F.sort_array(F.collect_list(item)).alias("items"))
        built = blocks.join(heights, "tree").withColumn(
            "height", F.least(F.greatest(F.col("levels") - k * STRATUM, F.lit(0)), F.lit(STRATUM)))
        top = F.element_at(_levels(F.col("items"), F.col("height")), -1)
        strata.append(checkpointed(built.select("tree", "block", "items", "height",
                                                F.get(top, F.lit(0))["digest"].alias("digest"))))
        level = strata[-1].select("tree", F.col("block").alias("rank"), "digest", F.lit(None).cast("boolean").alias("carried"))
    return strata, level.select("tree", "digest")


def _descended(strata: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Lowest nodes with carried, digest, proof, subroot and root; `tops` has tree, subroot, root and proof."""
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(strata):
        levels = _levels(F.col("items"), F.col("height"))
        met = blocks.drop("digest").join(above, ["tree", "block"]).withColumn("all_levels", levels)
        children = F.transform("items", lambda x, i: F.struct(
            x["rank"].alias("rank"), x["digest"].alias("digest"), x["carried"].alias("carried"),
            _siblings(F.col("all_levels"), F.col("height"), i).alias("inner")))
        each = met.select("tree", "subroot", "root", "proof", F.explode(children).alias("c"))
        above = each.select("tree", F.col("c.rank").alias("block"), F.col("c.digest").alias("digest"),
                            F.col("c.carried").alias("carried"), "subroot", "root",
                            F.concat("c.inner", "proof").alias("proof"))
        if blocks is not strata[0]:
            above = above.drop("digest", "carried")
    return above


def manifest(df: DataFrame, columns: list[str], group: str, order: str, carry: dict[str, Column] | None = None,
             ) -> DataFrame:
    """One row per row of `df`: key (of `order`), group, leaf, subroot, root, proof and the carried expressions.

    A proof is the array of (side, digest) from the leaf to the root: side -1 for
    a sibling on the left, 1 on the right, 0 with an empty digest for none.
    """
    carried = [c.alias(name) for name, c in (carry or {}).items()]
    leaves = df.select(F.struct(df[group].alias("group")).alias("tree"), df[order].alias("key"),
                       leaf_digest([df[c] for c in columns]).alias("digest"),
                       F.struct(df[order].alias("key"), *carried).alias("carried"))
    strata, subroots = _climbed(leaves, "key", "digest")
    # the tree over the groups: the groups are its leaves, in their order
    group_nodes = subroots.select(F.struct(F.lit(0).alias("all")).alias("tree"), F.col("tree").alias("of"), "digest",
                                  F.struct(F.col("tree").alias("of")).alias("carried"))
    upper, roots = _climbed(group_nodes, "of")
    tops = roots.select("tree", F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"),
                        F.array().cast(_PROOF).alias("proof"))
    groups = _descended(upper, tops).select(F.col("carried.of").alias("tree"), F.col("digest").alias("subroot"), "root",
                                            "proof")
    rows = _descended(strata, checkpointed(groups))
    return rows.select(F.col("carried.key").alias("key"), F.col("tree.group").alias("group"),
                       F.col("digest").alias("leaf"), "subroot", "root", "proof",
                       *[F.col(f"carried.{name}").alias(name) for name in (carry or {})])
