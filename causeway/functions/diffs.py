"""Unified diffs: a text per row in, a row a diff line out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions.traces import lines_of



def _spans(line: Column) -> Column:
    """struct(o, n, t): where a hunk header says that it begins in the old and the new file, and the text behind it; null for other lines."""
    words = F.split(line, " ", 4)
    start = lambda i, sign: F.when(F.get(words, F.lit(i)).startswith(sign), F.substring_index(F.substr(F.get(words, F.lit(i)), F.lit(2)), ",", 1).try_cast("int"))
    old, new, end = start(1, "-"), start(2, "+"), F.coalesce(F.get(words, F.lit(3)), F.lit(""))
    return F.when((F.get(words, F.lit(0)) == "@@") & old.isNotNull() & new.isNotNull() & end.startswith("@@"), F.struct(old.alias("o"), new.alias("n"), F.trim(F.substr(end, F.lit(3))).alias("t")))


def _path(line: Column) -> Column:
    p = F.trim(F.substr(line, F.lit(5)))
    return F.when(p.isin("/dev/null", "dev/null"), "").otherwise(F.regexp_replace(p, "^[ab]/", ""))


def diff_lines(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, file, hunk, header, old_start, new_start, pos, kind, text, old_no, new_no) of each line in a hunk.

    Everything is set-wise: what a line belongs to is the last header above it, and line numbers are the hunk's
    start plus the lines of the same side above. One window per diff; a null or empty diff has no rows.
    """
    above = W.partitionBy(*ids).orderBy("line_no")
    rows = df.where(F.col(text).isNotNull()).select(*ids, F.posexplode(F.split(text, r"\r\n|\n"))).select(*ids, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))
    line = F.col("line")
    start = line.startswith("diff --git ")
    header = _spans(line).isNotNull()
    name = line.startswith("--- ") | line.startswith("+++ ")
    rows = rows.withColumn("edge", ladder_edge(start, name, header))
    rows = rows.withColumn("old", F.last(F.when(line.startswith("--- ") & (F.col("edge") == "name"), _path(line)), True).over(above)).withColumn("new", F.last(F.when(line.startswith("+++ ") & (F.col("edge") == "name"), _path(line)), True).over(above))
    rows = rows.withColumn("state", F.last(F.when(F.col("edge") != "body", F.col("edge")), True).over(above))
    rows = rows.withColumn("hunk", F.sum(F.when(F.col("edge") == "hunk", 1).otherwise(0)).over(above))
    rows = rows.withColumn("h", F.last(F.when(F.col("edge") == "hunk", _spans(line)), True).over(above))
    body = rows.where((F.col("edge") == "body") & (F.col("state") == "hunk") & ~line.startswith("\\ No newline"))
    # the text ends with a line end: what follows it isn't a line
    last = F.max("line_no").over(W.partitionBy(*ids))
    body = body.withColumn("_last", last).where(~((line == "") & (F.col("line_no") == F.col("_last"))))
    kind = F.when(line.startswith("-"), "del").when(line.startswith("+"), "add").otherwise("context")
    body = body.withColumn("kind", kind)
    before = W.partitionBy(*ids, "hunk").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda other: F.coalesce(F.sum(F.when(F.col("kind") != other, 1).otherwise(0)).over(before), F.lit(0))
    return body.select(
        *ids,
        F.when(F.coalesce("new", F.lit("")) != "", F.col("new")).otherwise(F.col("old")).alias("file"),
        F.col("hunk").cast("int").alias("hunk"), F.col("h.t").alias("header"), F.col("h.o").alias("old_start"), F.col("h.n").alias("new_start"),
        F.row_number().over(W.partitionBy(*ids, "hunk").orderBy("line_no")).alias("pos"), "kind",
        F.when(line.rlike(r"^[-+ ]"), F.substr(line, F.lit(2))).otherwise(line).alias("text"),
        F.when(F.col("kind") != "add", F.col("h.o") + seen("add")).cast("int").alias("old_no"),
        F.when(F.col("kind") != "del", F.col("h.n") + seen("del")).cast("int").alias("new_no"),
    )


def ladder_edge(start: Column, name: Column, header: Column) -> Column:
    """What a line is by itself: the start of a file, a file name, a hunk header, or content."""
    return F.when(start, "file").when(name, "name").when(header, "hunk").otherwise("body")


def hunk_function(header: Column) -> Column:
    """The function named after a hunk header, if any."""
    return F.nullif(F.regexp_extract(header, r"([A-Za-z_~][\w:~]*)\s*\(", 1), F.lit(""))


def hunks(lines: DataFrame, ids: list[str]) -> DataFrame:
    """A row a hunk: before and after texts, added and removed statements in order."""
    keep = lambda kinds: F.array_join(F.transform(F.filter(F.col("all"), lambda x: x["kind"].isin(*kinds)), lambda x: x["text"]), "\n")
    said = lambda k: F.transform(F.filter(F.col("all"), lambda x: (x["kind"] == k) & (F.trim(x["text"]) != "") & ~F.trim(x["text"]).isin("{", "}")), lambda x: F.trim(x["text"]))
    grouped = lines.groupBy(*ids, "file", "hunk", "header", "old_start", "new_start").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("all"))
    return grouped.select(*ids, "file", "hunk", "header", "old_start", "new_start", hunk_function(F.col("header")).alias("function"), keep(("context", "del")).alias("before"), keep(("context", "add")).alias("after"), said("add").alias("added"), said("del").alias("removed"))


def looks_like_diff(text: Column) -> Column:
    return text.contains("--- ") & text.contains("+++ ") & text.contains("@@")
