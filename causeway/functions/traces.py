"""Stack traces, sanitizer reports and compiler diagnostics: a text per row in, its lines' facts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.rules import bound, ladder

def lines_of(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, line_no, line): each line of a text, numbered from 1."""
    return df.select(*ids, F.posexplode(F.split(text, r"\r\n|\r|\n"))).select(*ids, (F.col("pos") + 1).alias("line_no"), F.rtrim("col").alias("line"))


def _number(word: Column) -> Column:
    return F.coalesce(word.rlike("^[0-9]+$"), F.lit(False))


_PLACE = "struct<file:string,line:int,column:int>"
_FRAME = f"struct<format:string,index:int,function:string,place:{_PLACE},module:string,instruction:string>"


def place(text: Column) -> Column:
    """struct(file, line, column) of file:line or file:line:column, read from the right; null where there is no line."""

    def read(parts: Column) -> Column:
        n = F.size(parts)
        at = lambda back: F.get(parts, n - back)
        file = lambda used: F.array_join(F.slice(parts, F.lit(1), F.greatest(n - used, F.lit(0))), ":")
        both = F.struct(file(2).alias("file"), at(2).cast("int").alias("line"), at(1).cast("int").alias("column"))
        one = F.struct(file(1).alias("file"), at(1).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))
        said = F.when((n >= 3) & _number(at(1)) & _number(at(2)), both).when((n >= 2) & _number(at(1)), one)
        return bound(said, lambda x: F.when(x["file"] != "", x)).cast(_PLACE)

    return bound(F.split(text, ":"), read)


def _after(words: Column, n) -> Column:
    """The words from the n-th on, counted from 0."""
    return F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))


def _joined(words: Column, n=None) -> Column:
    """Words, or the first n of them, in one text; null if there are none."""
    some = words if n is None else F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))
    return F.nullif(F.array_join(some, " "), F.lit(""))


def _made(format: str, index: Column, function: Column, place: Column | None = None, module: Column | None = None, instruction: Column | None = None) -> Column:
    nothing = F.lit(None)
    parts = F.lit(format), F.coalesce(index, F.lit(0)), function, nothing if place is None else place, nothing if module is None else module, nothing if instruction is None else instruction
    names = ("format", "index", "function", "place", "module", "instruction")
    return F.struct(*(c.alias(n) for c, n in zip(parts, names, strict=True))).cast(_FRAME)


def _addressed(index: Column, address: Column, rest: Column) -> Column:
    """What follows `#1 0xADDRESS in`: FUNCTION file:line and more, or else FUNCTION (module+0xOFFSET)."""
    places = F.transform(rest, lambda w, i: F.when((i > 0) & ~w.startswith("("), place(w)))

    def placed(found: Column) -> Column:
        at = F.array_position(F.transform(found, lambda p: p.isNotNull()), True).cast("int")
        return bound(at, lambda k: F.when(k > 1, _made("sanitizer", index, _joined(rest, k - 1), F.get(found, k - 1))))

    def in_module(last: Column) -> Column:
        known = (F.size(rest) > 1) & last.startswith("(") & F.substring_index(last, "+0x", -1).rlike(r"^[0-9A-Fa-f]+\)$") & last.contains("+0x")
        name = F.substr(F.substring_index(last, "+0x", 1), F.lit(2))
        return F.when(known, _made("module", index, _joined(rest, F.size(rest) - 1), None, name, F.substr(address, F.lit(3))))

    return F.coalesce(bound(places, placed), bound(F.get(rest, F.size(rest) - 1), in_module))


def _at(index: Column, words: Column, first: Column) -> Column:
    """`#1 FUNCTION at file:line`, or `[frame #]1: at FUNCTION (file:line)`, `at` being the first-th word."""
    lead = F.regexp_replace(F.coalesce(_joined(words, first - 1), F.lit("")), "^frame #|:$", "")
    tail = F.array_join(_after(words, first), " ")

    def bracketed(t: Column) -> Column:
        inside = F.substr(t, F.instr(t, "(") + 1, F.greatest(F.length(t) - F.instr(t, "(") - 1, F.lit(0)))
        found = _made("parenthesis", lead.try_cast("int"), F.nullif(F.trim(F.substring_index(t, "(", 1)), F.lit("")), place(inside))
        return F.when(((lead == "") | _number(lead)) & t.contains(" (") & t.endswith(")"), bound(found, lambda f: F.when(f["place"].isNotNull(), f)))

    straight = bound(place(tail), lambda p: F.when(index.isNotNull() & (first > 2) & p.isNotNull(), _made("debugger", index, _joined(F.slice(words, F.lit(2), F.greatest(first - 2, F.lit(0)))), p)))
    return F.when(first > 0, F.coalesce(straight, bound(tail, bracketed)))


def _frame(line: Column) -> Column:
    """What a line says as a frame: its words are taken apart by what stands first, and by `in`, `at` and brackets."""

    def read(words: Column) -> Column:
        word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
        index = F.when(word(0).startswith("#") & _number(F.substr(word(0), F.lit(2))), F.substr(word(0), F.lit(2)).cast("int"))
        address = index.isNotNull() & word(1).rlike("^0x[0-9A-Fa-f]+$") & (word(2) == "in")
        by_address = bound(_after(words, F.lit(3)), lambda rest: _addressed(index, word(1), rest))
        by_at = bound(F.array_position(words, "at").cast("int"), lambda first: _at(index, words, first))
        return F.when(address, F.coalesce(by_address, by_at)).otherwise(by_at)

    return bound(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != ""), read)


def frames(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, line_no, format, index, function, file, line, column, module, instruction) of each frame line."""
    rows = lines_of(df, ids, text).select(*ids, "line_no", _frame(F.col("line")).alias("f")).where("f is not null")
    return rows.select(*ids, "line_no", "f.format", "f.index", "f.function", "f.place.file", "f.place.line", "f.place.column", "f.module", "f.instruction")


def bug_type(error: Column) -> Column:
    """The bug type that a sanitizer's error name stands for."""
    e = F.lower(error)
    return ladder([
        (e.contains("use-after-free"), "use_after_free"),
        (e.contains("buffer-overflow") | e.contains("out-of-bounds"), "buffer_overflow"),
        (e.contains("null"), "null_dereference"),
        (e.contains("integer") | e.contains("overflow"), "integer_overflow_to_memory_error"),
    ])


def sanitizer(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One row a report that says anything: summary, access, bug_type, and the trigger's file, line, column, function.

    The last summary line wins over the first error line; the last access line wins, and a line about freeing
    counts only while no access was seen; without a place in the summary the first frame is the trigger.
    """
    rows = lines_of(df, ids, text)

    def said(mark: str) -> Column:
        """struct(tool, error, rest) after a mark, where a sanitizer's name follows it."""
        after = F.substr(F.col("line"), F.instr(F.upper("line"), mark) + len(mark))
        tool, more = F.trim(F.substring_index(after, ":", 1)), F.trim(F.substr(after, F.instr(after, ":") + 1))
        error = F.regexp_extract(more, "^[A-Za-z0-9_-]+", 0)
        fits = (F.instr(F.upper("line"), mark) > 0) & F.lower(tool).rlike("^[a-z]+sanitizer$") & (error != "")
        return F.when(fits, F.struct(tool.alias("tool"), error.alias("error"), F.trim(F.substr(more, F.length(error) + 1)).alias("rest")))

    words = F.split(F.lower("line"), r"\W+")
    sized = lambda i, w: w.isin("read", "write") & (F.get(words, i + 1) == "of") & (F.get(words, i + 2) == "size") & _number(F.get(words, i + 3))
    access = F.get(F.filter(F.transform(words, lambda w, i: F.when(sized(i, w), w)), lambda w: w.isNotNull()), F.lit(0))
    frees = F.array_contains(words, "free") | F.lower("line").contains("freed by thread")
    marked = rows.select(*ids, "line_no", "line", said("ERROR:").alias("e"), said("SUMMARY:").alias("s"), access.alias("a"), frees.alias("f"))
    at, function = place(F.substring_index("s.rest", " in ", 1)), F.substr(F.col("s.rest"), F.instr("s.rest", " in ") + 4)
    marked = marked.withColumn("p", F.when(F.col("s.rest").contains(" in ") & at.isNotNull(), F.struct(at["file"].alias("file"), at["line"].alias("at"), at["column"].alias("col"), function.alias("function"))))
    told = marked.groupBy(*ids).agg(
        F.min_by("e", F.when(F.col("e").isNotNull(), F.col("line_no"))).alias("e"),
        F.max_by("s", F.when(F.col("s").isNotNull(), F.col("line_no"))).alias("s"),
        F.max_by("a", F.when(F.col("a").isNotNull(), F.col("line_no"))).alias("a"),
        F.bool_or("f").alias("f"),
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("line_no"))).alias("p"),
    )
    first = frames(df, ids, text).withColumn("n", F.row_number().over(W.partitionBy(*ids).orderBy("line_no"))).where("n = 1")
    first = first.select(*ids, F.struct("file", F.col("line").alias("at"), F.col("column").alias("col"), "function").alias("frame"))
    both = told.join(first, ids, "left").withColumn("said", F.coalesce("s", "e")).withColumn("place", F.coalesce("p", "frame"))
    return both.where("said is not null or a is not null or frame is not null").select(
        *ids,
        F.concat(F.col("said.tool"), F.lit(": "), F.col("said.error")).alias("summary"),
        F.coalesce("a", F.when(F.col("f"), "free")).alias("access"),
        bug_type(F.col("said.error")).alias("bug_type"),
        F.col("place.file").alias("file"), F.col("place.at").alias("line"), F.col("place.col").alias("column"), F.col("place.function").alias("function"),
    )


def diagnostics(df: DataFrame, ids: list[str], text: str) -> DataFrame:
    """(ids, line_no, file, line, column, message) of each compiler error."""
    rows = lines_of(df, ids, text)
    head, rest = F.substring_index("line", ": ", 1), F.substr(F.col("line"), F.instr("line", ": ") + 2)
    message = ladder([(rest.startswith(w), F.trim(F.substr(rest, F.lit(len(w) + 1)))) for w in ("error:", "fatal error:")])
    told = rows.select(*ids, "line_no", F.when(~F.col("line").startswith(" "), place(head)).alias("p"), message.alias("message"))
    return told.where("p.column is not null and message is not null").select(*ids, "line_no", "p.file", "p.line", "p.column", "message")


def crash_state(text: Column, most: int = 10) -> Column:
    """The names listed under `Crash State:`, up to an empty line or the next heading."""

    def listed(lines: Column) -> Column:
        head = F.array_position(F.transform(lines, lambda x: F.endswith(F.lower(F.rtrim(x)), F.lit("crash state:"))), True).cast("int")
        rest = bound(head, lambda h: F.when(h > 0, F.slice(lines, h + 1, F.greatest(F.size(lines) - h, F.lit(0)))))
        ends = lambda x: (F.trim(x) == "") | F.lower(x).contains("sanitizer:") | F.lower(x).contains("recommended security severity:")
        cut = bound(rest, lambda r: bound(F.array_position(F.transform(r, ends), True).cast("int"), lambda stop: F.when(stop > 0, F.slice(r, F.lit(1), stop - 1))))
        return F.slice(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: ~x.startswith("#")), 1, most)

    return F.coalesce(bound(F.split(text, r"\r\n|\n"), listed), F.array().cast("array<string>"))


def name_variants(name: Column) -> Column:
    """A function's name without template arguments, its last part without what stands in brackets, and that part's last word."""
    whole = F.trim(F.regexp_replace(name, "<[^>]*>", ""))
    last = lambda w: F.trim(F.substring_index(F.trim(F.substring_index(w, "::", -1)), "(", 1))
    return bound(whole, lambda w: bound(last(w), lambda x: F.array_distinct(F.filter(F.array(w, x, F.substring_index(x, " ", -1)), lambda v: v != ""))))


def fuzz_target(text: Column) -> Column:
    line = F.get(F.filter(F.split(text, r"\r\n|\n"), lambda x: x.startswith("Fuzz Target:")), F.lit(0))
    return F.nullif(F.get(F.filter(F.split(F.substr(line, F.lit(13)), r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))


def testcase_id(text: Column) -> Column:
    """The number of the test case that a download link names."""
    mark = "/download?testcase_id="
    after = F.substr(text, F.instr(text, mark) + len(mark))
    return F.when(F.instr(text, mark) > 0, F.nullif(F.regexp_extract(after, "^[0-9]+", 0), F.lit("")))
