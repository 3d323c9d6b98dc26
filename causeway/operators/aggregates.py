"""Distributions, shares, votes, merges and clusters. All aggregate partially before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.operators.ranking import numbered, topk
from causeway.rules import ladder


def distribution(df: DataFrame, value: Column, name: str = "value", missing: str | None = None) -> DataFrame:
    """(value, n). With `missing`, nulls are counted under that name."""
    v = F.coalesce(value.cast("string"), F.lit(missing)) if missing is not None else value
    return df.groupBy(v.alias(name)).agg(F.count("*").alias("n"))


def list_distribution(df: DataFrame, values: Column, k: int, name: str = "value") -> DataFrame:
    """The k most frequent elements of an array column."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """A column of counts for each listed value; zero where there are none."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def bins(value: Column, edges: Sequence[float], open_top: bool = True) -> Column:
    """The label of the first bin, from the top, whose lower edge the value reaches."""
    rules = [(value >= e, f">={e:.2f}") for e in sorted(edges, reverse=True)]
    return ladder([(value.isNull(), "missing"), *rules], f"<{min(edges):.2f}")


def success(df: DataFrame, by: Sequence[str], first: Column, second: Column) -> DataFrame:
    """n, success, rate a group; a first count of zero falls through to the second one."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(first).alias("_a"), F.count_if(second).alias("_b"))
    total = F.coalesce(F.nullif(F.col("_a"), F.lit(0)), F.col("_b"))
    return counts.select(*by, "n", total.alias("success"), F.round(total / F.col("n"), 4).alias("rate"))


def shares(df: DataFrame, group: str, value: str, min_support: int = 1) -> DataFrame:
    """(group, value, n, share of the group), for groups of at least min_support rows."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(group))
    return counts.withColumn("_t", total).where(F.col("_t") >= min_support).select(group, value, "n", F.round(F.col("n") / F.col("_t"), 4).alias("share"))


def boosts(df: DataFrame, value: str, cap: float) -> DataFrame:
    """min(n / all, cap) of each value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(value, F.round(F.least(F.col("n") / F.col("_t"), F.lit(cap)), 4).alias("boost"))


def clusters(df: DataFrame, keys: Sequence[str], min_support: int, name: str = "cluster_id") -> DataFrame:
    """Groups of min_support rows or more, numbered by falling size, then key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    return numbered(counts, [F.desc("support"), *keys], name)


def top_values(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ranked."""
    return topk(df.groupBy(group, value).agg(F.count("*").alias("n")), [group], [F.desc("n"), value], k)


def modal(df: DataFrame, group: Sequence[str], value: str, min_share: float = 0.0) -> DataFrame:
    """The most frequent value of each group (the smaller one on a tie), if its share reaches min_share."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.max("_n").alias("top"), F.min(F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b")))["b"].alias("mode"))
    return best.withColumn("share", F.round(F.col("top") / F.col("n"), 4)).where(F.col("top") / F.col("n") >= min_share).drop("top")


def vote(df: DataFrame, key: Sequence[str], candidate: str, weight: Column) -> DataFrame:
    """The candidate with the most weight; the larger one on a tie."""
    votes = df.groupBy(*key, candidate).agg(F.sum(weight).alias("votes"))
    return votes.groupBy(*key).agg(F.max(F.struct("votes", candidate)).alias("b")).select(*key, f"b.{candidate}", "b.votes")


def first_known(c: str, order: Column, unknown: str = "unknown") -> Column:
    """The earliest value that isn't null or unknown."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != unknown), order))


def longest(c: str) -> Column:
    """The longest text, the lexicographically first on a tie; null texts don't count."""
    return F.min(F.when(F.col(c).isNotNull(), F.struct((-F.length(c)).alias("a"), F.col(c).alias("b"))))["b"]


def ordered_distinct(value: str, order: str, k: int | None = None) -> Column:
    """Distinct values in the order in which they first come, the first k of them if k is given."""
    out = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]))
    return F.slice(out, 1, k) if k else out


def merged_score(score: str, flags: Sequence[tuple[Column, float]]) -> Column:
    """The best score plus a boost for each flag, if the group has more than one row; 1 at most."""
    boost = F.lit(0.0)
    for c, b in flags:
        boost = boost + F.when(c, b).otherwise(0.0)
    return F.least(F.max(score) + F.when(F.count("*") > 1, boost).otherwise(0.0), F.lit(1.0))


def rate(condition: Column) -> Column:
    return F.round(F.count_if(condition) / F.count("*"), 4)
