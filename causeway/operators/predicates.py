"""Filters and splits that say why a row goes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.rules import ladder, truthy

KEEP = "keep"


def with_reason(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "reason") -> DataFrame:
    """Adds the name of the first rule that a row breaks, or "keep"."""
    return df.withColumn(name, ladder(rules, KEEP))


def split(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(kept rows, discarded rows with their reason)."""
    marked = with_reason(df, rules, name)
    return marked.where(F.col(name) == KEEP).drop(name), marked.where(F.col(name) != KEEP)


def reason_counts(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "reason") -> DataFrame:
    return with_reason(df, rules, name).groupBy(name).agg(F.count("*").alias("n"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each check. A null check isn't broken."""
    return df.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(k) for k, c in checks.items()))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)


def host_in(host: Column, names: Sequence[str]) -> Column:
    """The host is one of the names or a subdomain of one."""
    out = F.lit(False)
    for n in names:
        out = out | (host == n) | host.endswith("." + n)
    return truthy(out)


def choice(c: Column, allowed: Sequence[str], default: str) -> Column:
    """A closed vocabulary: anything else becomes the default."""
    token = F.trim(F.lower(c))
    return F.when(token.isin(list(allowed)), token).otherwise(F.lit(default))


def overlay(*layers: Column) -> Column:
    """Configuration layers from the weakest to the strongest; nulls let the weaker one through."""
    return F.coalesce(*reversed(layers))
