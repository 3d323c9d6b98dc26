"""Ordered rule ladders as columns: the first rule that holds decides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN over (condition, value); a null condition doesn't hold."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for condition, result in rules:
        out = F.when(condition, value(result)) if out is None else out.when(condition, value(result))
    return value(default) if out is None else out.otherwise(value(default))


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the text holds one of the phrases; plain substring tests, no regex."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return F.coalesce(out, F.lit(False))


def truthy(c: Column) -> Column:
    """NULL and false alike count as not."""
    return F.coalesce(c, F.lit(False))


def is_not(c: Column, value: object) -> Column:
    """Three-valued `is not`: NULL is neither true nor false, so it differs from both."""
    return ~c.eqNullSafe(F.lit(value))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def or_default(c: Column, default: object) -> Column:
    """A zero counts as missing, as in `x or default`."""
    return F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]
