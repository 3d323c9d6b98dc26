"""Distances, bounded paths and reachability over many graphs at once, each with its own key."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.operators.ranking import topk


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one where that is unset and all run on one machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="causeway-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def distances(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(g, node, distance): the fewest links from a node to a start of its graph, against the links' direction.

    edges: g, src, dst. starts: g, node. A breadth-first search by frontier joins; each round's frontier is what
    the anti-join leaves, and lineage is cut once a round, so the plan doesn't grow with the depth.
    """
    seen = cut_lineage(starts.select("g", "node", F.lit(0).alias("distance")).distinct())
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier.select("g", F.col("node").alias("dst")), ["g", "dst"]).select("g", F.col("src").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["g", "node"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def bounded_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int, max_paths: int, priority: Column | None = None) -> DataFrame:
    """(g, start, path, rank): simple paths from a start to its graph's end, at most max_paths of them and max_depth links long.

    They come in the order of a depth-first search that tries nearer nodes first, then relations by priority, then
    ids: each step adds (distance, priority, id) to a sort key. A path is dropped as soon as what is left of it can't
    fit, or max_paths others come before it for sure. A path is sure to reach the end if it has come nearer with its
    last step than ever before: the nearest way on from there meets no node that it has passed.
    """
    back = cut_lineage(distances(edges, ends, max_depth))
    near = back.select("g", F.col("node").alias("dst"), "distance")
    rank = priority if priority is not None else F.lit(0)
    links = edges.withColumn("_p", rank).join(near, ["g", "dst"]).groupBy("g", "src", "dst", "distance").agg(F.min("_p").alias("_p"))
    links = cut_lineage(links)
    begun = starts.select("g", "node").distinct().join(back, ["g", "node"])  # what can't reach the end has no path
    ways = begun.select("g", F.col("node").alias("start"), F.col("node").alias("at"), F.array(F.col("node")).alias("path"), F.array().cast("array<struct<d:int,p:int,n:string>>").alias("key"), F.col("distance").alias("least"))
    goal = ends.select("g", F.col("node").alias("goal"))
    done = None
    order = W.partitionBy("g", "start").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    for depth in range(1, max_depth + 1):
        step = ways.join(links.withColumnRenamed("src", "at"), ["g", "at"])
        step = step.where(~F.array_contains("path", F.col("dst")) & (F.lit(depth) + F.col("distance") <= max_depth))
        key = F.concat("key", F.array(F.struct(F.col("distance").cast("int").alias("d"), F.col("_p").cast("int").alias("p"), F.col("dst").cast("string").alias("n"))))
        ways = step.select("g", "start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), key.alias("key"), F.least("least", "distance").alias("least"), (F.col("distance") < F.col("least")).alias("sure")).join(goal, "g", "left")
        ways = ways.withColumn("done", F.coalesce(F.col("at") == F.col("goal"), F.lit(False))).drop("goal").withColumn("sure", F.col("sure") | F.col("done"))
        pool = ways if done is None else ways.unionByName(done)
        pool = cut_lineage(pool.withColumn("n", F.coalesce(F.sum(F.col("sure").cast("int")).over(order), F.lit(0))).where(F.col("n") < max_paths).drop("n"))
        done, ways = pool.where("done"), pool.where("not done").drop("sure", "done")
        if ways.isEmpty():
            break
    return topk(done, ["g", "start"], ["key"], max_paths).select("g", "start", "path", "rank")


def reach(defs: DataFrame, uses: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(g, stmt): statements that a start depends on, through definitions that come before a use.

    defs: g, stmt, line, name. uses: the same. starts: g, stmt. The set form of a backward slice.
    """
    d = defs.select("g", F.col("stmt").alias("src"), F.col("line").alias("l1"), "name")
    u = uses.select("g", F.col("stmt").alias("dst"), F.col("line").alias("l2"), "name")
    edges = cut_lineage(d.join(u, ["g", "name"]).where("l1 < l2").select("g", "src", "dst").distinct())
    return distances(edges, starts.select("g", F.col("stmt").alias("node")), max_rounds).select("g", F.col("node").alias("stmt"))


def reverse_bfs_sql(spark: SparkSession, edges: str, starts: str, max_depth: int) -> DataFrame:
    """distances() as a recursive query over views, for shallow graphs."""
    return spark.sql(
        f"with recursive r(g, node, d) max recursion level {max_depth + 2} as (select g, node, 0 from {starts} union all "
        f"select e.g, e.src, r.d + 1 from {edges} e join r on e.g = r.g and e.dst = r.node where r.d < {max_depth}) "
        "select g, node, min(d) as distance from r group by g, node"
    )
