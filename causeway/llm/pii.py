"""Personal data: fixed patterns, and contexts learned from what they find, with DataFrame functions only.

The fixed patterns give the seeds. The words before a seed make a lexical pattern; patterns and the
identifiers that follow them form a graph, on which confidence goes to and fro a few times: a pattern is
trusted as far as the identifiers it introduces are, and an identifier as far as its patterns are. Trusted
patterns then mark identifiers that no fixed pattern knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import Scratch, text_key

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The patterns as the contract gives them, written so that a long run of one class is tried once only: a match
#: begins where its run begins, or where the last match ended, and loops don't give back what they took.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
CUES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_TOKEN = "A-Za-z0-9_@.+-"
#: An identifier: a run of token characters with a digit in it.
IDENTIFIER = rf"(?<![{_TOKEN}])[{_TOKEN}]*[0-9][{_TOKEN}]*+"
CONTEXT_CHARS, CONTEXT_WORDS = 64, 2
ROUNDS, MIN_SEEDS, TRUST = 3, 3, 0.7
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,context:string>>"
_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """The sum before each element, in blocks: no step copies more than a block, or the sums of all blocks."""
    return F.transform(F.array(numbers), _sums)[0]  # bound to a name, so that it isn't worked out again for each block


def _sums(numbers: Column) -> Column:
    n = F.size(numbers)
    grow = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)))
    within = F.transform(blocks, grow)
    before = grow(F.transform(within, lambda w: F.element_at(w, -1)))
    sums = F.flatten(F.zip_with(within, F.slice(before, F.lit(1), F.size(within)), lambda w, o: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: x + o)))
    return F.when(n > 0, sums).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.expr("cast(null as int)"), F.substring(F.ltrim(x, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The last words before a place, lower-cased; null if there are fewer."""
    words = F.regexp_extract_all(F.lower(F.right(before, F.lit(CONTEXT_CHARS))), F.lit(r"\p{L}+"), F.lit(0))
    return F.when(F.size(words) >= CONTEXT_WORDS, F.array_join(F.slice(words, -CONTEXT_WORDS, CONTEXT_WORDS), " "))


def _spans(between: Column, found: Column, sums: Column, kind: str, rank: int) -> Column:
    """The spans of one kind from what stands between the matches, the matches, and the lengths before each."""
    places = F.transform(
        F.arrays_zip(between.alias("b"), found.alias("f"), sums.alias("s")),
        lambda x, i: F.struct(
            (x["s"] + F.length(x["b"])).alias("start"),
            F.lit(rank).alias("rank"),
            (x["s"] + F.length(x["b"]) + F.length(x["f"])).alias("end"),
            F.lit(kind).alias("kind"),
            x["f"].alias("value"),
            _context(x["b"]).alias("context"),
        ),
    )
    return F.filter(places, lambda x: x["value"].isNotNull() & _valid(kind, x["value"])).cast(_SPAN)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, base (the valid spans of the fixed patterns in order), tokens (identifiers with their contexts)."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    tried = {k: (F.contains(F.col("t"), F.lit("@")) if k == "email" else F.col("t").rlike(CUES[k])) for k in KINDS} | {"token": F.col("t").rlike("[0-9]")}
    patterns = PATTERNS | {"token": IDENTIFIER}
    cut = rows.select("id", "t", *(F.when(tried[k], F.split("t", p, -1)).alias(f"b_{k}") for k, p in patterns.items()), *(F.when(tried[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(f"f_{k}") for k, p in patterns.items()))
    cut = cut.select("id", "t", *(F.coalesce(c, none).alias(c) for k in patterns for c in (f"b_{k}", f"f_{k}")))
    whole = lambda k: F.transform(F.arrays_zip(F.col(f"b_{k}").alias("b"), F.col(f"f_{k}").alias("f")), lambda x: F.length(x["b"]) + F.coalesce(F.length(x["f"]), F.lit(0)))
    summed = cut.select("*", *(F.when(F.size(f"f_{k}") > 0, running_sums(whole(k))).otherwise(F.array().cast("array<int>")).alias(f"s_{k}") for k in patterns))
    kinds = [F.when(F.size(f"f_{k}") > 0, _spans(F.col(f"b_{k}"), F.col(f"f_{k}"), F.col(f"s_{k}"), k, i)).otherwise(F.array().cast(_SPAN)).alias(f"x_{k}") for i, k in enumerate(patterns)]
    spans = summed.select("id", "t", *kinds)
    base = F.array_sort(F.concat(*(f"x_{k}" for k in KINDS)))
    return spans.select("id", F.when(F.size("x_token") + F.size("x_email") > 0, text_key(F.col("t"))).alias("key"), base.alias("base"), F.col("x_token").alias("tokens"))


def learn(places: DataFrame, scratch: Scratch, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, trust: float = TRUST) -> DataFrame:
    """(context, value, kind or null) -> (context, kind, confidence) of the trusted patterns.

    Confidence of a pattern for a kind: the mean trust in its distinct identifiers, if at least min_seeds of them
    are trusted. Trust in an identifier: 1 for a seed of the kind; else 1 - product of (1 - confidence) over its
    patterns, as far as that reaches `trust`.
    """
    edges = scratch.write(places.where("context is not null").groupBy("context", "value").agg(F.max("kind").alias("kind"), F.count("*").alias("n")))
    # tables of their own, so that the rows of a hot value or context can be split among tasks
    exact = "decimal(28,18)"  # sums that don't depend on the order
    seeds = scratch.write(edges.where("kind is not null").select("value", "kind", F.lit(1.0).alias("trust")).distinct())
    total = edges.groupBy("context").agg(F.count("*").alias("m"))
    trusted = seeds
    patterns = None
    for _ in range(rounds):
        marked = edges.select("context", "value").join(trusted, "value")
        scored = marked.groupBy("context", "kind").agg(F.sum(F.col("trust").cast(exact)).cast("double").alias("s"), F.count("*").alias("k")).where(F.col("k") >= min_seeds).join(total, "context")
        old, patterns = patterns, scratch.write(scored.select("context", "kind", (F.col("s") / F.col("m")).alias("confidence")).where(F.col("confidence") >= trust))
        met = edges.where("kind is null").join(patterns.withColumnRenamed("kind", "k"), "context").groupBy("value", F.col("k").alias("kind"))
        new = met.agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))).cast(exact)).cast("double"))).alias("trust")).where(F.col("trust") >= trust)
        before, trusted = trusted, scratch.write(seeds.unionByName(new))
        if old is not None:
            scratch.discard(old)
            scratch.discard(before)
    return patterns


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id, key, base and added spans (start, rank, end, kind, value, context).

    Offsets count code points, ends are exclusive. Added spans are called context_<kind>. Null and empty texts
    have none. Rows with one text share their spans; repeated rows stay. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    scanned = scratch.write(scan(docs, id_col, text_col))
    texts = scanned.where("key is not null").groupBy("key").agg(F.first("base").alias("base"), F.first("tokens").alias("tokens"))
    places = texts.select("key", F.explode(F.concat("base", "tokens")).alias("s")).select("key", "s.*")
    # identifiers that touch a fixed span are part of it
    by_place = "partition by key order by start, rank"
    marked = places.withColumn("past", F.expr(f"max(if(kind <> 'token', end, 0)) over ({by_place} rows between unbounded preceding and 1 preceding)"))
    marked = marked.withColumn("next", F.expr("min(if(kind <> 'token', start, null)) over (partition by key order by start desc, rank desc rows between unbounded preceding and 1 preceding)"))
    free = (F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    places = scratch.write(marked.where((F.col("kind") != "token") | free).drop("past", "next"))
    patterns = learn(places.select("context", "value", F.when(F.col("kind") != "token", F.col("kind")).alias("kind")), scratch)
    best = scratch.write(patterns.groupBy("context").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("found")))
    hits = places.where("kind = 'token'").join(best, "context")
    added = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.concat(F.lit("context_"), "found").alias("kind"), "value", "context"))).cast(_SPAN).alias("added"))
    none = F.array().cast(_SPAN)
    plain = scanned.where("key is null").select("id", "key", "base", none.alias("added"))
    rest = scanned.where("key is not null").join(added, "key", "left").select("id", "key", "base", F.coalesce("added", none).alias("added"))
    return plain.unionByName(rest)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each input row; see find()."""
    rows = find(docs, **kw)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(F.col("id").alias("doc_id"), *(count(k) for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with every span in text_col replaced by its kind in brackets; overlapping spans become one.

    Texts without spans, null ones among them, stay as they are. All columns stay.
    """
    found = find(docs, id_col, text_col).where(F.size("base") + F.size("added") > 0).dropDuplicates(["key"])
    found = merged(found.select(F.col("key").alias("_key"), F.explode(F.concat("base", "added")).alias("s")))
    holds = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    row = docs.where(holds).select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), text_key(F.col(text_col)).alias("_key")).join(found, "_key", "left")
    t = F.col("_row")[text_col]
    starts = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda x: x["end"]))
    parts = F.transform(F.col("_spans"), lambda x, i: F.concat(F.substring(t, F.get(starts, i) + 1, x["start"] - F.get(starts, i)), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    text = F.when(F.col("_spans").isNull(), t).otherwise(F.concat(F.array_join(parts, ""), F.substring(t, F.element_at(starts, -1) + 1, F.length(t))))
    return row.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns)).unionByName(docs.where(~holds))


def merged(spans: DataFrame) -> DataFrame:
    """(_key, s) -> _key, _spans: disjoint (start, end, kind of the first) in order."""
    before = "partition by _key order by start, rank, end rows between unbounded preceding and"
    rows = spans.select("_key", "s.start", "s.rank", "s.end", "s.kind").withColumn("past", F.expr(f"max(end) over ({before} 1 preceding)"))
    rows = rows.withColumn("part", F.expr(f"count_if(past is null or past <= start) over ({before} current row)"))
    whole = rows.groupBy("_key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank", "end")).alias("kind"))
    return whole.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
