"""Public records and their fixes: what a record is about, which commits fix it, where a patch anchors in old code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.rules import any_of, ladder, truthy

#: Spellings of languages.
LANGUAGES = {"c": ("c", "c89", "c99", "c11"), "cpp": ("c++", "cpp", "cxx"), "c_cpp": ("c_cpp", "c/c++", "c-cpp")}
#: Words of a description that are worth searching a history for.
HISTORY_WORDS = ("overflow", "underflow", "bounds", "length", "size", "oob", "uaf", "null", "check")
#: How far a way of finding a fix commit is trusted.
TRUST = {"commit": 1.0, "reference": 0.8, "named": 0.95, "cve_id_search": 0.9, "alias_search": 0.75, "issue_reference_search": 0.65, "issue_elsewhere": 0.55, "pull_request_search": 0.6, "keyword_search": 0.25}
#: Words of messages and lines that tell what a patch does.
BOUNDS = ("bound", "bounds", "length", "size", "offset", "capacity", "index", "overflow", "oob")
CHECKS = ("if", "assert", "validate", "check", "guard", "null", "nullptr", "return")
TIDYING = ("refactor", "rename", "restructure", "cleanup", "style", "format")
MEMORY_WORDS = ("memcpy", "memmove", "memset", "malloc", "calloc", "realloc", "free", "delete", "new")
MEMORY_CALLS = ("memcpy", "memmove", "memset", "strcpy", "strncpy", "free", "malloc", "calloc", "realloc")
#: Words that say nothing about a statement.
STOP = ("if", "for", "while", "return", "else", "switch", "case", "sizeof", "const", "int", "char", "void", "long", "short", "unsigned", "signed")


def language(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return ladder([(v.isin(*names), k) for k, names in LANGUAGES.items()], "unknown")


def infer_language(explicit: Column, hints: Column, *keys: Column) -> Column:
    """The language that is said, else that of the first key among hints (a map), else unknown."""
    found = F.coalesce(*(F.try_element_at(hints, k) for k in keys))
    return F.when(F.coalesce(explicit, F.lit("")) != "", language(explicit)).when(found.isNotNull(), language(found)).otherwise("unknown")


def infer_project(explicit: Column, repo_url: Column, products: Column, packages: Column) -> Column:
    """What is said, else the last part of the repository's path, else the first product or package."""
    leaf = F.element_at(F.filter(F.split(F.regexp_extract(repo_url, "^[a-z]+://[^/]+/([^?#]*)", 1), "/"), lambda p: p != ""), -1)
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(F.coalesce(repo_url, F.lit("")) != "", leaf), first(products), first(packages), F.lit("unknown_project"))


def relevant(language: Column, cwes: Column, text: Column, known_cwes: tuple[str, ...], phrases: tuple[str, ...]) -> Column:
    """A record of C or C++, by its language, its weakness ids or what its text says."""
    by_id = truthy(F.arrays_overlap(cwes, F.array(*map(F.lit, known_cwes))))
    return truthy(language.isin("c", "cpp", "c_cpp")) | by_id | any_of(F.lower(text), phrases)


def high_value(confidence: Column, pattern: Column, bug_class: Column, repo_url: Column, references: Column, patterns: tuple[str, ...], classes: tuple[str, ...], least: float) -> Column:
    """A record worth checking against its source."""
    return truthy((confidence >= least) & (pattern.isin(*patterns) | bug_class.isin(*classes)) & (repo_url != "") & F.exists(references, lambda r: r["commit_sha"].isNotNull()))


def trace_notes(repo_url: Column, language: Column, fix_commits: Column, kinds: Column) -> Column:
    """What couldn't be told about a record, in order."""
    later = truthy(F.arrays_overlap(kinds, F.array(F.lit("pull_request"), F.lit("compare"))))
    none = F.size(F.coalesce(fix_commits, F.array().cast("array<string>"))) == 0
    notes = [
        F.when(repo_url.isNull(), "Repository URL could not be inferred from advisory references."),
        F.when(language == "unknown", "Language remains unknown; record was retained only because keep_unknown_language=True."),
        F.when(none & later, "No direct fix commit URL found; PR/compare references were preserved for later resolution.").when(none, "No fix commit could be inferred from advisory references."),
    ]
    return F.array_compact(F.array(*notes))


def version_sources(versions: Column) -> Column:
    """Where affected versions come from: a CPE, or else a range."""
    return F.filter(F.transform(versions, lambda v: F.coalesce(F.nullif(v["cpe_uri"], F.lit("")), F.nullif(v["range"], F.lit("")))), lambda v: v.isNotNull())


def description_words(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)))
    return F.filter(found, lambda w: w.isin(*HISTORY_WORDS))


def fix_commits(found: DataFrame, most: int = 5) -> DataFrame:
    """(record, commit_sha, url, summary, score, matched_by, evidence_url), a row a way of finding -> a row a commit, the `most` best of a record.

    The first url and summary that are there count, by the highest trust and then by name.
    """
    order = F.struct(F.col("score"), F.col("matched_by"))
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    one = found.groupBy("record", "commit_sha").agg(
        best("url").alias("url"), best("summary").alias("summary"), F.max("score").alias("score"),
        F.sort_array(F.collect_set("matched_by")).alias("matched_by"), F.sort_array(F.collect_set("evidence_url")).alias("evidence_urls"),
    )
    at = F.row_number().over(W.partitionBy("record").orderBy(F.desc("score"), F.desc("commit_sha")))
    return one.withColumn("rank", at).where(F.col("rank") <= most)


def patch_type(lines: DataFrame, ids: list[str], message: str, description: str, intent: str) -> DataFrame:
    """(ids, patch_type) from a patch's changed lines (kind, text) and what its message, record and intent say."""
    low = F.lower(F.trim("text"))
    added = F.col("kind") == "add"
    changed = lines.where(F.col("kind") != "context")
    any_line = lambda c: F.coalesce(F.max(truthy(c)), F.lit(False))
    computes = F.exists(F.array(*map(F.lit, ("+", "-", "*", "/", "%", "<<", ">>"))), lambda o: F.contains(F.trim("text"), o)) | F.regexp_replace("text", "[=!<>]=", "").contains("=")
    told = changed.groupBy(*ids).agg(
        any_line(added & F.regexp_replace(low, r"\s", "").rlike(r"(^|\W)if\(")).alias("check"),
        any_line(any_of(low, BOUNDS)).alias("bounds"), any_line(any_of(low, MEMORY_WORDS)).alias("memory"),
        any_line(added & any_of(low, CHECKS)).alias("checks"), any_line(computes).alias("computes"),
        *(F.first(F.lower(F.coalesce(F.col(c), F.lit("")))).alias(c) for c in (message, description, intent)),
    )
    m, says = F.col(message), any_of(F.col(description), BOUNDS)
    in_bounds = F.col("bounds") | any_of(m, BOUNDS)
    add = lambda *pairs: sum((F.when(truthy(c), v).otherwise(0) for c, v in pairs), F.lit(0))
    guarded = F.col(intent).isin("defensive_guard", "compensating_check")
    scored = told.select(
        *ids, m.alias("m"), F.col(intent).alias("intent"), "check", in_bounds.alias("in_bounds"),
        add((in_bounds, 2), (F.col("memory"), 1), (says & F.col("memory"), 1)).alias("b"),
        add((F.col("check"), 2), (F.col("checks"), 1), (guarded, 2)).alias("c"),
        add((F.col("memory"), 1), (F.col("computes"), 2), (any_of(m, ("fix", "overflow", "underflow", "invalid")), 1), (F.col(intent) == "direct_fix", 1)).alias("d"),
    )
    kind = ladder([
        (any_of(F.col("m"), TIDYING[:3]), "refactor"), (any_of(F.col("m"), TIDYING), "cleanup"),
        (F.col("check") & F.col("in_bounds"), "bounds_fix"), (F.col("check"), "added_check"),
        ((F.col("b") >= F.greatest("c", "d")) & (F.col("b") >= 2), "bounds_fix"), ((F.col("c") >= F.greatest("b", "d")) & (F.col("c") >= 2), "added_check"),
        (F.col("d") >= 2, "direct_fix"), (F.col("intent").isin("cleanup", "refactor"), F.col("intent")),
    ], "unknown")
    return scored.select(*ids, kind.alias("patch_type"))


def names_of(text: Column) -> Column:
    """Distinct lower-case names of a text that say something."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z_][a-z0-9_]*"), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(*STOP))


def plain(text: Column) -> Column:
    """A statement without spaces at its ends, runs of them as one, and without the signs that end it."""
    return F.trim(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(" ;{}"))


def anchors(hunks: DataFrame, statements: DataFrame, ids: list[str]) -> DataFrame:
    """Where a hunk anchors in the old file: (ids, hunk, file, line, kind, tier), each place once.

    hunks: ids, file, hunk, old_start, old_count, function, added, removed, before; statements: file, func, line,
    text. The first tier that gives anything counts: removed text near the hunk (0) or anywhere in the file (1),
    the two statements that share most names with what is added (2), context lines near it (3), the nearest
    statement (4); else the hunk's first line (9).
    """
    h = hunks.withColumn("lo", F.greatest(F.lit(1), F.col("old_start") - 2)).withColumn("hi", F.col("old_start") + F.greatest("old_count", F.lit(1)) + 2)
    h = h.withColumn("gone", F.transform("removed", plain)).withColumn("put", names_of(F.array_join("added", " "))).withColumn("around", F.transform(F.split("before", "\n"), plain))
    s = statements.select("file", F.col("line").alias("at"), "func", "text", plain(F.col("text")).alias("p"), names_of(F.col("text")).alias("names"))
    met = h.join(s, "file")
    near = F.col("at").between(F.col("lo"), F.greatest("hi", "lo"))
    shares = F.size(F.array_intersect("put", "names"))
    gone, only_added = F.array_contains("gone", F.col("p")), (F.size("added") > 0) & (F.size("removed") == 0)
    tier = ladder([
        (gone & near, 0), (gone, 1), ((F.size("added") > 0) & (shares > 0) & near, 2),
        ((F.size("added") == 0) & F.array_contains("around", F.col("p")) & (F.col("p") != "") & near, 3), (near, 4),
    ])
    off = F.abs(F.col("at") - F.greatest(F.lit(1), F.col("old_start") + F.col("old_count") - 1))
    order = [F.when(F.col("tier") == 2, -shares), F.when(F.col("tier") == 2, -off), F.when(F.col("tier") == 4, F.abs(F.col("at") - F.col("old_start"))), F.when(F.col("tier") == 2, -F.col("at")).otherwise(F.col("at"))]
    key = [*ids, "file", "hunk"]
    found = met.withColumn("tier", tier).where("tier is not null")
    found = found.withColumn("best", F.min("tier").over(W.partitionBy(*key))).where("tier = best").withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    found = found.where((F.col("tier") < 2) | ((F.col("tier") < 4) & (F.col("n") <= 2)) | (F.col("n") == 1)).select(*key, F.col("at").alias("line"), "tier")
    kind = ladder([(F.size("removed") > 0, "removed_statement"), (F.size("added") > 0, "insertion_site")], "patch_context")
    out = h.select(*key, "old_start", kind.alias("kind"), only_added.alias("_only")).join(found, key, "left")
    return out.select(*key, F.coalesce("line", F.greatest(F.lit(1), F.col("old_start"))).alias("line"), "kind", F.coalesce("tier", F.lit(9)).alias("tier")).dropDuplicates([*ids, "file", "line", "kind"])


def anchor_operation(texts: Column) -> Column:
    """The first memory call that is named in one of the texts, texts and calls in order."""
    hits = F.transform(texts, lambda t: F.get(F.filter(F.array(*map(F.lit, MEMORY_CALLS)), lambda c: F.contains(F.lower(t), c)), F.lit(0)))
    return F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0))


def described_bug(text: Column) -> Column:
    """The bug type that a description speaks of."""
    t = F.lower(text)
    return ladder([(any_of(t, ("overflow", "out-of-bounds", "oob", "buffer")), "buffer_overflow"), (any_of(t, ("use-after-free", "uaf")), "use_after_free"), (t.contains("null") & t.contains("dereference"), "null_dereference")])


def augmented(candidates: DataFrame, anchor: DataFrame, ids: list[str]) -> DataFrame:
    """Candidates against the anchor of their record (file, line, func, entities, patch_type): what the patch says of each."""
    a = anchor.select(*ids, *(F.col(c).alias(f"_{c}") for c in ("file", "line", "func", "entities", "patch_type")))
    both = candidates.join(a, ids)
    at_file = F.col("file") == F.col("_file")
    overlap = truthy(at_file & (F.col("line") == F.col("_line")))
    shared = F.size(F.array_intersect(F.transform("tracked_entities", F.lower), F.col("_entities"))) > 0
    return both.select(
        *candidates.columns,
        overlap.alias("patch_anchor_overlap"), truthy(at_file).alias("same_file_as_patch"), truthy((F.col("func") == F.col("_func")) & (F.col("func") != "")).alias("same_function_as_patch"),
        truthy(F.col("defines_value_used_later") & shared).alias("defines_value_later_fixed"),
        truthy(F.col("_patch_type").isin("added_check", "bounds_fix") & (truthy(F.col("affects_control_flow")) | overlap)).alias("missing_check_replaced"),
        truthy(F.col("_patch_type").isin("direct_fix", "bounds_fix") & F.col("has_integer_influence")).alias("incorrect_computation_replaced"),
        truthy(~overlap & (~at_file | (F.col("line") <= F.col("_line")))).alias("upstream_from_patch"),
    )


def patch_relation(candidates: DataFrame, anchor_places: DataFrame, hunks: DataFrame, ids: list[str]) -> DataFrame:
    """Candidates with how they stand to the patch: on an anchor, in a hunk, in a changed function or file, or outside."""
    places = anchor_places.select(*ids, "file", "line").distinct().withColumn("_anchor", F.lit(True))
    spans = hunks.select(*ids, "file", "function", F.col("old_start").alias("lo"), (F.col("old_start") + F.greatest("old_count", F.lit(1)) - 1).alias("hi"))
    files = spans.groupBy(*ids, "file").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"), F.collect_set("function").alias("_functions"))
    known = hunks.select(*ids).distinct().withColumn("_patch", F.lit(True))
    both = candidates.join(places, [*ids, "file", "line"], "left").join(files, [*ids, "file"], "left").join(known, ids, "left")
    inside = truthy(F.exists("_spans", lambda x: F.col("line").between(x["lo"], x["hi"])))
    relation = ladder([
        (truthy(F.col("patch_anchor_overlap")), "patch_anchor_overlap"), (truthy(F.col("_anchor")), "patch_anchor"), (F.col("_patch").isNull(), "unknown"),
        (inside, "patched_statement"), (truthy(F.array_contains("_functions", F.col("func")) & (F.col("func") != "")), "same_function_as_patch"),
        (F.col("_spans").isNotNull(), "same_file_as_patch"), (truthy(F.col("candidate_origin") == "upstream_slice"), "upstream_of_patch"),
    ], "outside_patched_files")
    return both.select(*candidates.columns, relation.alias("patch_relation"))


def changed_places(lines: DataFrame, statements: DataFrame, functions: DataFrame, ids: list[str]) -> DataFrame:
    """Changed diff lines as places in the old file: deletions by their old numbers, additions by their new ones, moved to a statement at most a line away; with the function around."""
    at = F.when(F.col("kind") == "del", F.col("old_no")).otherwise(F.col("new_no"))
    rows = lines.where(F.col("kind") != "context").select(*ids, "file", "kind", "text", at.alias("at"))
    near = rows.join(statements.select("file", F.col("line").alias("s")), "file").where(F.abs(F.col("s") - F.col("at")) <= 1)
    key = [*ids, "file", "kind", "text", "at"]
    snapped = near.groupBy(*key).agg(F.min(F.struct(F.abs(F.col("s") - F.col("at")).alias("d"), F.col("s"))).alias("n")).select(*key, F.col("n.s").alias("s"))
    placed = rows.join(snapped, key, "left").select(*ids, "file", "kind", F.coalesce("s", "at").alias("line"), "text")
    around = placed.join(functions.select("file", "func", F.col("line").alias("lo"), F.col("end_line").alias("hi")), "file").where(F.col("line").between(F.col("lo"), F.col("hi")))
    named = around.groupBy(*ids, "file", "kind", "line", "text").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("n"), "lo", "func")).alias("f")).select(*ids, "file", "kind", "line", "text", F.col("f.func").alias("func"))
    return placed.join(named, [*ids, "file", "kind", "line", "text"], "left").dropDuplicates([*ids, "file", "kind", "line", "text"])


def library_summary(patterns: DataFrame) -> DataFrame:
    """One row about a library: patterns, least, most and total support, the most frequent category and operation."""
    counts = lambda c: patterns.groupBy(c).agg(F.count("*").alias("n")).agg(F.max_by(c, F.struct("n", c)))
    one = patterns.agg(F.count("*").alias("patterns"), F.min("support_count").alias("least"), F.max("support_count").alias("most"), F.sum("support_count").alias("total"))
    return one.crossJoin(counts("category").toDF("category")).crossJoin(counts("operation_type").toDF("operation_type"))


def repo_path(records: DataFrame, by_cve: DataFrame, by_name: DataFrame) -> DataFrame:
    """Records with the path of their repository: by cve_id, else by URL, else by project."""
    a = by_cve.select("cve_id", F.col("path").alias("_a")).dropDuplicates(["cve_id"])
    n = by_name.dropDuplicates(["name"])
    out = records.join(a, "cve_id", "left").join(n.select(F.col("name").alias("repo_url"), F.col("path").alias("_b")), "repo_url", "left").join(n.select(F.col("name").alias("project"), F.col("path").alias("_c")), "project", "left")
    return out.select(*records.columns, F.coalesce("_a", "_b", "_c").alias("path"))


#: Words of a case's texts and the pattern and operation that they stand for, in the order in which they are tried.
CASE_PATTERNS = (
    ("invalid_initialization", "initialization", ("uninitialized", "initialize", "initialization")),
    ("incorrect_size_computation", "length_calculation", ("size", "length", "index", "bounds", "overflow")),
    ("ownership_or_lifetime_operation", "lifetime_management", ("free", "use-after-free", "lifetime", "double-free")),
    ("validation_or_guard_issue", "guard_check", ("null", "guard", "check", "validation")),
)


def case_pattern(matched: Column, text: Column) -> Column:
    """The first matched pattern that says something, else what the texts of a case speak of."""
    said = F.get(F.filter(matched, lambda p: p.isNotNull() & ~p.isin("", "none", "unknown")), F.lit(0))
    return F.coalesce(said, ladder([(any_of(F.lower(text), words), p) for p, _, words in CASE_PATTERNS], "invalid_state_update"))


def case_operation(pattern: Column) -> Column:
    return ladder([(pattern == p, o) for p, o, _ in CASE_PATTERNS], "state_update")
