"""Correlation: unique names, ranges, nearest rows, best matches, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.ranking import keep_best

#: A side is broadcast only if it was counted and has no more rows than this.
SMALL = 100_000
#: Characters of JSON that may be broadcast.
SMALL_BYTES = 32 << 20


def few(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> bool:
    """Whether the rows are few and, as text, not large."""
    n, length = df.limit(rows + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()
    return n <= rows and (length or 0) <= size


def small(df: DataFrame, rows: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """The frame, marked for broadcast if its rows are few and, as text, not large; others are left to the optimizer."""
    return F.broadcast(df) if few(df, rows, size) else df


def unique_match(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """Adds `target` where exactly one row of the right has the key, and how many have it."""
    defined = right.groupBy(key).agg(F.count("*").alias("n_targets"), F.min(target).alias("_one"))
    out = left.join(defined, key, "left")
    return out.withColumn(target, F.when(F.col("n_targets") == 1, F.col("_one"))).withColumn("n_targets", F.coalesce("n_targets", F.lit(0))).drop("_one")


def range_join(points: DataFrame, ranges: DataFrame, key: Sequence[str], point: str, low: str, high: str, order: Sequence[Column | str], ids: Sequence[str], bucket: int | None = None) -> DataFrame:
    """Each point with the first range, in `order`, that holds it; null where none does.

    With `bucket` (for integer points), ranges are copied to each bucket they touch and the equi-join takes the
    bucket too, so that a key with many ranges doesn't meet all of its points.
    """
    if bucket:
        p = points.withColumn("_b", F.floor(F.col(point) / bucket))
        r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
        on = [*key, "_b"]
    else:
        p, r, on = points, ranges, list(key)
    held = p.join(r, on).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_b")
    best = keep_best(held, ids, order)
    rest = points.join(best.select(*ids), list(ids), "left_anti")
    return best.unionByName(rest, allowMissingColumns=True)


def nearest_start(points: DataFrame, ranges: DataFrame, key: Sequence[str], point: str, low: str, order: Sequence[Column | str], ids: Sequence[str]) -> DataFrame:
    """Each point with the range whose start lies nearest."""
    both = points.join(ranges, list(key))
    return keep_best(both, ids, [F.abs(F.col(point) - F.col(low)), *order])


def band_join(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, other: str, width: int, ids: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Each left row with the nearest right row at most `width` away.

    Both sides are cut into bands of that width and right rows copied to the two neighbouring ones, so that the
    join is an equi-join on key and band.
    """
    a = left.withColumn("_band", F.floor(F.col(at) / width))
    b = right.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(other) / width) + d)))
    gap = F.abs(F.col(at) - F.col(other))
    met = a.join(b, [*key, "_band"]).where(gap <= width).drop("_band").withColumn("gap", gap)
    return keep_best(met, ids, ["gap", *order])


def best_match(rows: DataFrame, library: DataFrame, pairs: Sequence[tuple[str, str]], score: Callable[[Column], Column], ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The best library entry that agrees with a row in at least one of the (row column, library column) pairs.

    One equi-join a pair with the entries of a key in a list, instead of a nested loop. `score` takes an entry, and the
    best one is found within the row, so that no task holds or sorts a row for each entry met.
    """
    share = F.broadcast if few(library) else lambda df: df
    last = F.lit(float("inf"))  # where there is no score
    first = lambda e: F.struct(F.coalesce(-score(e), last).alias("_o"), *(e[c].alias(c) for c in order), e.alias("_e"))
    met = rows
    for i, (a, b) in enumerate(pairs):
        known = library.groupBy(F.col(b).alias(f"_k{i}")).agg(F.collect_list(F.struct(*library.columns)).alias(f"_m{i}"))
        met = met.join(share(known), F.col(a) == F.col(f"_k{i}"), "left")
    best = F.array_min(F.array(*(F.array_min(F.transform(f"_m{i}", first)) for i in range(len(pairs)))))
    met = met.select(*rows.columns, best.alias("_b")).where("_b is not null").select(*rows.columns, "_b._e.*", F.when(F.col("_b._o") < last, -F.col("_b._o")).alias("score"))
    return keep_best(met, ids, [F.desc("score"), *order])


def best_agreement(rows: DataFrame, library: DataFrame, pairs: Sequence[tuple[str, str]], score: Callable[[Sequence[Column]], Column], ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As `best_match`, for scores that take nothing of a row but which pairs agree, and don't fall when more of them do.

    For each choice of pairs the best entry of a key is found in the library alone, so a row meets one entry a choice
    and not all of its key. An entry that agrees in more than it was chosen for is met with its own score as well.
    """
    share = F.broadcast if few(library) else lambda df: df
    met, found = rows, []
    for agree in product((True, False), repeat=len(pairs)):
        if not any(agree):
            continue
        keys, name = [p for p, yes in zip(pairs, agree) if yes], f"_m{len(found)}"
        best = keep_best(library.withColumn("score", score([F.lit(yes) for yes in agree])), [b for _, b in keys], [F.desc("score"), *order])
        first = F.struct(F.col("score").isNull(), -F.col("score"), *order, F.struct(*library.columns, "score").alias("entry"))
        best = best.select(*(F.col(b).alias(f"{name}_{b}") for _, b in keys), first.alias(name))
        met = met.join(share(best), reduce(lambda x, y: x & y, (F.col(a) == F.col(f"{name}_{b}") for a, b in keys)), "left")
        found.append(name)
    met = met.select(*rows.columns, F.array_min(F.array(*found))["entry"].alias("_entry")).where("_entry is not null").select(*rows.columns, "_entry.*")
    return keep_best(met, ids, [F.desc("score"), *order])


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the base replaced by changes with the same key, new ones appended; null changes let the base through."""
    values = [c for c in base.columns if c not in key]
    a, b = base.select(*key, F.struct(*values).alias("_a")), changes.select(*key, F.struct(*values).alias("_b"))
    return a.join(b, list(key), "full").select(*key, *(F.coalesce(F.col("_b")[c], F.col("_a")[c]).alias(c) for c in values))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """NULL equals NULL."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*(f"_r_{k}" for k in keys))


def by_suffix(paths: DataFrame, files: DataFrame, path: str, file: str, widths: Sequence[int] = (4, 3, 2, 1)) -> DataFrame:
    """Adds `resolved`: the only file that ends in the same 4, 3, 2 or 1 last parts of the path, the widest first."""
    tail = lambda c, n: F.when(F.size(F.split(c, "/")) >= n, F.array_join(F.slice(F.split(c, "/"), -n, n), "/"))
    known = files.select(F.col(file).alias("_f"), F.explode(F.array(*(F.struct(F.lit(n).alias("w"), tail(F.col(file), n).alias("s")) for n in widths))).alias("_t"))
    one = known.where("_t.s is not null").groupBy("_t.w", "_t.s").agg(F.count("*").alias("_n"), F.min("_f").alias("_f")).where("_n = 1")
    want = paths.select(path).distinct().select(path, F.explode(F.array(*(F.struct(F.lit(n).alias("w"), tail(F.col(path), n).alias("s")) for n in widths))).alias("_t"))
    met = want.where("_t.s is not null").select(path, F.col("_t.w").alias("w"), F.col("_t.s").alias("s")).join(one, ["w", "s"])
    return paths.join(met.groupBy(path).agg(F.max_by("_f", "w").alias("resolved")), path, "left")


def window_text(locations: DataFrame, lines: DataFrame, file: str, line: str, before: int, after: int, ids: Sequence[str]) -> DataFrame:
    """The source text around each location: lines from `before` above to `after` below."""
    wide = locations.withColumn("line_no", F.explode(F.sequence(F.greatest(F.col(line) - before, F.lit(1)), F.col(line) + after)))
    met = wide.join(lines.select(F.col("file").alias(file), "line_no", "text"), [file, "line_no"])
    return met.groupBy(*ids).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("window"))
