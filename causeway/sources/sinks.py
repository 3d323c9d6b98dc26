"""Writers: documents, logs, tables for people, manifests."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, path: str) -> None:
    """A JSON document a row, keys in order; Spark's commit makes the folder appear whole."""
    ordered = df.select(F.to_json(F.struct(*sorted(df.columns)), {"pretty": "false"}).alias("value"))
    ordered.write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def csv(df: DataFrame, path: str) -> None:
    """Fixed columns with a header; arrays are joined by semicolons."""
    flat = [F.array_join(F.col(c), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def _few(df: DataFrame, most: int) -> list:
    """Rows for a report; a report of more rows than `most` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    return rows


def markdown(df: DataFrame, most: int = 1000) -> str:
    rows = _few(df, most)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join("-" for _ in df.columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]) + "\n"


def html(df: DataFrame, title: str, most: int = 1000) -> str:
    """A page of its own with one table; all text is escaped."""
    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in _few(df, most))
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def manifest(df: DataFrame) -> DataFrame:
    """(path, sha256, size) of binaryFile rows."""
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
