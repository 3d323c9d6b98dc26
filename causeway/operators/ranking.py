"""Ranking, top-k and selection; every order ends in a unique key, so results don't depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

Cols = Sequence[str | Column]


def _number(partition: Cols, order: Cols) -> Column:
    return F.row_number().over(W.partitionBy(*partition).orderBy(*order))


def topk(df: DataFrame, partition: Cols, order: Cols, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(name, _number(partition, order)).where(F.col(name) <= k)


def keep_best(df: DataFrame, key: Cols, order: Cols) -> DataFrame:
    """The first row of each key."""
    return topk(df, key, order, 1, "_n").drop("_n")


def backfill_topk(df: DataFrame, partition: Cols, order: Cols, score: str, threshold: float, k: int, name: str = "rank") -> DataFrame:
    """k rows a group: those that reach the threshold first, then the best of the rest.

    The threshold is a preference, not a filter: groups with too few good rows are filled up.
    """
    good = F.when(F.col(score) >= threshold, 0).otherwise(1)
    return topk(df, partition, [good, *order], k, name)


def promote_best(df: DataFrame, partition: Cols, label: str, wanted: str, score: str, tie: Cols, eligible: Column) -> DataFrame:
    """If no row of a group has the wanted label, the eligible row with the highest score gets it."""
    group = W.partitionBy(*partition)
    has = F.max(F.when(F.col(label) == wanted, 1).otherwise(0)).over(group)
    first = F.row_number().over(group.orderBy(F.when(eligible, 0).otherwise(1), F.desc(score), *tie))
    out = df.withColumn("_has", has).withColumn("_first", first)
    return out.withColumn(label, F.when((F.col("_has") == 0) & (F.col("_first") == 1) & eligible, F.lit(wanted)).otherwise(F.col(label))).drop("_has", "_first")


def diversify(df: DataFrame, key: Cols, order: Cols, per_key: int, limit: int, name: str = "rank") -> DataFrame:
    """At most per_key rows of each key, then the first `limit` of all.

    The limit is taken first as a top-k (a bounded sort); the numbering runs over what is left.
    """
    capped = topk(df, key, order, per_key, "_n").drop("_n").orderBy(*order).limit(limit)
    return capped.withColumn(name, F.row_number().over(W.orderBy(*order)))


def cap_then_sort(df: DataFrame, key: Cols, arrival: Cols, cap: int, order: Cols, name: str = "rank") -> DataFrame:
    """The first `cap` rows of each key by arrival; only then are they ranked."""
    return topk(df, key, arrival, cap, "_n").drop("_n").withColumn(name, _number(key, order))


def balanced(df: DataFrame, group: Cols, kind: Cols, order: Cols, size: int, name: str = "rank") -> DataFrame:
    """`size` rows a group: one of each kind first, then others in order."""
    seen = df.withColumn("_tier", F.when(_number([*group, *kind], order) == 1, 0).otherwise(1))
    return topk(seen, group, ["_tier", *order], size, name).drop("_tier")


def numbered(df: DataFrame, order: Cols, name: str) -> DataFrame:
    """Rows numbered from 1 in a total order.

    Positions come from a range partitioning and partition sizes, not from one sorted task.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = laid.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    return placed.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_i")).cast("int")).drop("_p", "_i", "_before")


def shard(df: DataFrame, order: Cols, n: int, name: str = "shard") -> DataFrame:
    """Round robin over a total order: row i goes to i mod n."""
    return numbered(df, order, name).withColumn(name, F.pmod(F.col(name) - 1, F.lit(n)))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same ones for a seed whatever the order: those whose hashed keys come first."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def numeric_id(c: Column) -> list[Column]:
    """Order of ids: numbers by value, then the rest as text."""
    return [c.try_cast("bigint").asc_nulls_last(), c.asc()]


def until_budget(df: DataFrame, partition: Cols, order: Cols, size: Column, budget: int) -> DataFrame:
    """Rows in order until their sizes reach the budget; the row that crosses it is kept."""
    before = F.sum("_size").over(W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_size", size).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < budget).drop("_size", "_before")


def force_include(df: DataFrame, partition: Cols, order: Cols, k: int, prefer: Column, name: str = "rank") -> DataFrame:
    """Top k, but the best preferred row takes the last place if none made it."""
    group = W.partitionBy(*partition)
    ranked = df.withColumn("_n", _number(partition, order)).withColumn("_p", F.coalesce(prefer, F.lit(False)))
    ranked = ranked.withColumn("_in", F.max(F.when((F.col("_n") <= k) & F.col("_p"), 1).otherwise(0)).over(group)).withColumn("_best", F.min(F.when(F.col("_p"), F.col("_n"))).over(group))
    swap = (F.col("_in") == 0) & F.col("_best").isNotNull()
    keep = F.when(swap, (F.col("_n") < k) | (F.col("_n") == F.col("_best"))).otherwise(F.col("_n") <= k)
    return ranked.where(keep).withColumn(name, F.least(F.col("_n"), F.lit(k))).drop("_n", "_p", "_in", "_best")
