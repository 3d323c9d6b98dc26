"""Benchmark decontamination with DataFrame functions only.

The hashes of all benchmark windows form a set that travels with the plan to every executor. Each document's
words are scanned once: a position is looked up by its first three words, then by the whole window. What is
found is verified word for word against the windows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import Scratch, text_key

WINDOW = 10
#: Words of lower-cased text; digits, a to z and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing, with what stands before a word.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many windows at most go into the plan as a set, and are broadcast to be verified (about 20 MB); more are joined.
MAX_SET = 50_000


def words_of(text: Column) -> Column:
    """lower() is enough, and faster, where all is ASCII."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, size, win (its words), h, h3: each item's windows; items without words or id have none."""
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = words.withColumn("size", F.least(F.size("w"), F.lit(window)))
    cut = sized.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("win"))
    return cut.withColumn("h", F.xxhash64("win")).withColumn("h3", F.xxhash64(*(F.get("win", F.lit(i)) for i in range(3)))).distinct()


def scan(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, max_set: int = MAX_SET) -> DataFrame:
    """id, key, n_words, hits (array of i, size, h, win): the places of each text that look like a window."""
    sizes = [(r["size"], r["n"]) for r in windows.groupBy("size").agg(F.countDistinct("h").alias("n")).orderBy("size").collect()]  # at most WINDOW rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", text_key(F.col("t")).alias("key"), words_of(F.col("t")).alias("w"))
    small = sum(n for _, n in sizes) <= max_set
    parts = []
    for size, _ in sizes:
        tests = []
        if small:
            mine = windows.where(F.col("size") == size)
            listed = lambda c, mine=mine: ", ".join(f"{r[0]}L" if r[0] != -(1 << 63) else "-9223372036854775807L - 1L" for r in mine.select(c).distinct().collect())  # noqa: E731  proven small
            if size >= 3:
                tests.append(f"xxhash64(get(w, i - 1), get(w, i), get(w, i + 1)) in ({listed('h3')})")
            tests.append(f"xxhash64(slice(w, i, {size})) in ({listed('h')})")
        places = f"filter(sequence(1, size(w) - {size - 1}), i -> {' and '.join(tests) or 'true'})"
        parts.append(f"if(size(w) < {size}, array(), transform({places}, i -> struct(i as i, {size} as size, xxhash64(slice(w, i, {size})) as h, slice(w, i, {size}) as win)))")
    kind = "array<struct<i:int,size:int,h:bigint,win:array<string>>>"
    if not parts:
        return rows.select("id", "key", F.size("w").alias("n_words"), F.array().cast(kind).alias("hits"))
    if small:
        return rows.select("id", "key", F.size("w").alias("n_words"), F.expr(f"cast(flatten(array({', '.join(parts)})) as {kind})").alias("hits"))
    # too many windows for the plan: the places themselves meet the windows, text by text
    heads = windows.select("size", "h").distinct()
    texts = rows.groupBy("key").agg(F.first("w").alias("w"))
    places = texts.select("key", F.explode(F.expr(f"cast(flatten(array({', '.join(parts)})) as {kind})")).alias("p")).select("key", "p.*")
    met = places.join(heads, ["size", "h"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("i", "size", "h", "win")).alias("hits"))
    return rows.select("id", "key", F.size("w").alias("n_words")).join(met, "key", "left").select("id", "key", "n_words", F.coalesce("hits", F.array().cast(kind)).alias("hits"))


def verified(scanned: DataFrame, windows: DataFrame, max_set: int = MAX_SET) -> DataFrame:
    """key, i, size, item of each true occurrence; texts that occur repeatedly are taken once."""
    texts = scanned.where(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits"))
    places = texts.select("key", F.explode("hits").alias("p")).select("key", "p.*")
    known = windows.select("size", "h", "win", "item")
    if known.limit(max_set + 1).count() <= max_set:
        known = F.broadcast(known)
    return places.join(known, ["size", "h", "win"]).select("key", "i", "size", "item")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_set: int = MAX_SET) -> tuple[DataFrame, DataFrame]:
    """(a row for each input row: id, key, n_words, n_hit, items; the hit word positions of each text: key, positions).

    items: the distinct item ids as sorted strings. Null and empty texts have no words, no hits. Items without
    id or words find nothing; an id that repeats counts once. Repeated rows each get their row. Empty tables
    give no rows, or no hits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.write(windows_of(items, item_col, "text", window))
    scanned = scratch.write(scan(docs, windows, id_col, text_col, max_set))
    true = scratch.write(verified(scanned, windows, max_set))
    positions = true.select("key", F.explode(F.expr("sequence(i, i + size - 1)")).alias("p")).distinct().groupBy("key").agg(F.collect_list("p").alias("positions"))
    named = true.select("key", F.col("item").cast("string").alias("item")).distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    by_text = positions.join(named, "key").select("key", F.size("positions").cast("long").alias("n_hit"), "items")
    none = scanned.where(F.size("hits") == 0).select("id", "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    some = scanned.where(F.size("hits") > 0).select("id", "key", "n_words").join(by_text, "key", "left")
    some = some.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return none.unionByName(some), positions


def digest(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each input row; see find()."""
    rows, _ = find(docs, items, **kw)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The input with contaminated documents removed, or (mode "spans") with the hit words cut out of their texts.

    A cut takes the words and what stands before each of them. Rows without hits, null texts among them, stay
    as they are. All columns stay; of the others only text_col may change.
    """
    _, positions = find(docs, items, id_col, text_col, **kw)
    key = text_key(F.col(text_col))
    if mode == "documents":
        row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), key.alias("_key"))  # no name of the input can clash
        kept = row.join(positions.select(F.col("key").alias("_key")), "_key", "left_anti")
        return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), key.alias("_key")).join(positions.select(F.col("key").alias("_key"), F.col("positions").alias("_hit")), "_key", "left")
    pieces = F.regexp_extract_all(F.col("_row")[text_col], F.lit(PIECE), F.lit(0))
    rest = F.filter(F.transform(pieces, lambda x, i: F.when(~F.array_contains(F.col("_hit"), i + 1), x)), lambda x: x.isNotNull())
    text = F.when(F.col("_hit").isNull(), F.col("_row")[text_col]).otherwise(F.concat(F.array_join(rest, ""), F.regexp_extract(F.col("_row")[text_col], TAIL, 0)))
    return row.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
