"""Merkle trees over key-range hashes: find changed records by descending only where digests differ.

A record is (key columns, state column). Its key hash places it in one of ``fanout ** depth`` equal ranges of the
64-bit hash space, so leaves stay even however skewed the keys are. A leaf digest is a set hash of its records (two
independent 64-bit sums and a count); an inner digest hashes its children in order. Trees are small DataFrames
(level, node, digest) that are stored beside the output they describe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Shape:
    """Tree shape: both sides of a comparison must have the same."""

    depth: int = 2
    bits: int = 6  # fan-out 64: 4,096 leaves at depth 2
    segment_bits: int = 2  # ranges of the hash space that are stored and rewritten as one

    @property
    def leaf_bits(self) -> int:
        return self.depth * self.bits

    @staticmethod
    def for_rows(rows: int, leaf_rows: int = 64, segment_rows: int = 1_000_000) -> Shape:
        """A shape whose leaves hold about ``leaf_rows`` records and whose segments at most about ``segment_rows``."""
        depth, segments = 1, 2
        while depth < 6 and 64**depth * leaf_rows < rows:
            depth += 1
        while segments < min(12, 6 * depth) and 2**segments * segment_rows < rows:
            segments += 1
        return Shape(depth=depth, segment_bits=segments)


def leaf_of(keys: list[str], shape: Shape) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - shape.leaf_bits)


def segment_of(leaf: Column, shape: Shape) -> Column:
    return F.shiftrightunsigned(leaf, shape.leaf_bits - shape.segment_bits).cast("int")


def leaves(records: DataFrame, keys: list[str], state: list[str], shape: Shape) -> DataFrame:
    """(node, digest) of the lowest level; sums are partially aggregated before the shuffle."""
    # nulls do not change a hash; their positions are therefore hashed beside the values
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in [*keys, *state]])
    h1, h2 = F.xxhash64(*keys, *state, mask), F.xxhash64(F.lit("salt"), mask, *state, *keys)
    mod = F.lit(1 << 40)
    return (
        records.select(leaf_of(keys, shape).alias("node"), h1.alias("h1"), h2.alias("h2")).groupBy("node")
        .agg(F.sum(F.pmod("h1", mod)).alias("a"), F.sum(F.pmod("h2", mod)).alias("b"), F.bit_xor("h1").alias("c"), F.count(F.lit(1)).alias("n"))
        .select("node", F.xxhash64("a", "b", "c", "n").alias("digest"))
    )


def tree(records: DataFrame, keys: list[str], state: list[str], shape: Shape) -> DataFrame:
    """All levels: (level, node, digest), level 0 is the root. An empty input gives an empty tree.

    The leaves are written first, so the records are read once for all levels above.
    """
    level = cut(leaves(records, keys, state, shape))
    levels = [level.select(F.lit(shape.depth).alias("level"), "node", "digest")]
    for k in range(shape.depth - 1, -1, -1):
        level = (
            level.groupBy(F.shiftright("node", shape.bits).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("kids"))
            .select(F.col("up").alias("node"), F.xxhash64("kids").alias("digest"))
        )  # a node has at most 2 ** bits children
        levels.append(level.select(F.lit(k).alias("level"), "node", "digest"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


#: Nodes of a level that may come to the driver as literals of the next level's filter.
FEW = 4_096


def differing_leaves(now: DataFrame, saved: DataFrame, shape: Shape) -> DataFrame:
    """(node) of the leaves whose digests differ, found from the root down.

    Only children of differing nodes are compared at each level; of levels with at most ``FEW`` nodes the differing ones
    become a filter of the next, of larger levels they are written and joined. A node missing on one side differs.
    """
    at, nodes = None, None
    for k in range(shape.depth + 1):
        sides = []
        for tree_, name in ((now, "a"), (saved, "b")):
            x = tree_.filter(F.col("level") == k).select("node", F.col("digest").alias(name))
            if nodes is not None:
                x = x.filter(F.shiftright("node", shape.bits).isin(nodes))
            elif at is not None:
                x = x.join(at, F.shiftright(x["node"], shape.bits) == at["up"], "left_semi")
            sides.append(x)
        found = sides[0].join(sides[1], "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if k == shape.depth:
            return found
        if 1 << (shape.bits * k) <= FEW:
            nodes, at = [r[0] for r in found.collect()], None
        else:
            nodes, at = None, cut(found.select(F.col("node").alias("up")))
    raise AssertionError("a tree has a leaf level")


def changed(now: DataFrame, saved: DataFrame, keys: list[str], state: list[str], shape: Shape, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Records of ``now`` that ``saved`` lacks or has in another state, from the differing leaves only."""
    a, b = trees or (cut(tree(now, keys, state, shape)), cut(tree(saved, keys, state, shape)))
    at = cut(differing_leaves(a, b, shape))
    pick = lambda df: df.withColumn("_leaf", leaf_of(keys, shape)).join(at, F.col("_leaf") == F.col("node"), "left_semi").drop("_leaf")
    n, s = pick(now).alias("n"), pick(saved.select(*keys, *state)).alias("s")
    on = F.lit(True)
    for c in [*keys, *state]:
        on = on & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    return n.join(s, on, "left_anti")


def removed(now: DataFrame, saved: DataFrame, keys: list[str], state: list[str], shape: Shape, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Keys that ``saved`` has and ``now`` lacks."""
    gone = changed(saved.select(*keys, *state), now.select(*keys, *state), keys, state, shape, trees and trees[::-1])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"g.{c}").eqNullSafe(F.col(f"n.{c}"))
    return gone.alias("g").join(now.select(*keys).alias("n"), on, "left_anti").select(*keys)
