"""Connected components by repeated hooking and contraction, all of it in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links between long ids -> (node, component), component being the smallest id of the node's component.

    Each round hooks every node to the neighbour (or itself) that comes first in a hashed order, jumps one
    pointer further, and keeps the links that are left between the new nodes. The hashed order makes the
    number of nodes fall by a constant factor a round whatever the shape of the graph, so long chains of
    rising ids don't need a round a link. Nulls and self links are ignored; no edges give no rows.
    Neighbours are never collected: a hub's links are reduced by a partially aggregated minimum.
    """
    rest = scratch.write(edges.select("a", "b").where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        hooked = scratch.write(
            both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["id"].alias("par"))
        )
        far = hooked.select(F.col("node").alias("par"), F.col("par").alias("far"))
        jumped = scratch.write(hooked.join(far, "par").select("node", F.col("far").alias("par")))
        maps.append(jumped)
        left = jumped.select(F.col("node").alias("a"), F.col("par").alias("x"))
        right = jumped.select(F.col("node").alias("b"), F.col("par").alias("y"))
        old, rest = rest, scratch.write(
            rest.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        scratch.discard(old)
        scratch.discard(hooked)
    if not maps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("par"), F.col("par").alias("next"))
        out = out.join(step, "par", "left").select("node", F.coalesce("next", "par").alias("par"))
    out = scratch.write(out)
    least = scratch.write(out.groupBy("par").agg(F.min("node").alias("component")))  # apart, so that a hub's rows can be split
    return out.join(least, "par").select("node", "component")
