"""A second look at mined records: what to do with each candidate, with each record, and how to score again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.rules import any_of, clamp, ladder, truthy

#: Relations to a patch that make a candidate worth another look.
NEAR_PATCH = ("patch_anchor_overlap", "patched_statement", "same_function_as_patch")
#: Classes of bugs that are worth most, words of a reply that cast doubt on a place or a pattern, that speak of
#: symptoms, and of what lies around a function; patterns that say little.
HIGH_VALUE = (
    "buffer_overflow", "heap_buffer_overflow", "stack_buffer_overflow", "out_of_bounds_read", "out_of_bounds_write", "use_after_free",
    "double_free", "null_dereference", "integer_overflow", "integer_underflow", "memory_corruption", "type_confusion",
)
LOCATION_DOUBTS = ("location", "outside patched", "unrelated file", "not clearly", "does not clearly", "weak", "mismatch", "patch")
PATTERN_DOUBTS = ("overbroad", "too broad", "generic", "pattern", "vulnerability class", "incorrect size", "wrong")
SYMPTOMS = ("symptom", "downstream", "use site", "crash", "visible", "consumed")
AROUND = ("caller", "callee", "interprocedural", "data flow", "control flow", "state", "lifetime", "ownership")
GENERIC = ("", "none", "unknown", "incorrect_size_computation")
PATCH_ACTIONS = ("rerun_slice_from_patch_context", "demote_symptoms_and_search_upstream")


def candidate_action(label: Column, relation: Column, blob: Column, weak: tuple[str, ...] = LOCATION_DOUBTS) -> Column:
    """What a judged candidate is to become; weak: phrases that say its place is doubtful."""
    return ladder([
        (label == "correct", "retain_candidate"),
        (label == "partially_correct", "promote_for_recheck"),
        (label.isin("likely_incorrect", "uncertain"), "replace_candidate"),
        (relation.isin(*NEAR_PATCH), "promote_for_recheck"),
        ((relation == "outside_patched_files") & any_of(blob, weak), "demote_symptom_or_noise"),
    ], "recheck_with_more_context")


def pattern_action(label: Column, action: Column, pattern: Column, blob: Column, weak: tuple[str, ...] = PATTERN_DOUBTS) -> Column:
    """The same for its pattern."""
    return ladder([
        (label.isin("weak_or_noisy", "likely_incorrect") | (action == "drop"), "avoid_or_split_pattern"),
        ((label == "valid_but_broad") | action.isin("manual_review", "merge"), "specialize_pattern"),
        (pattern.isin("none", "unknown", "incorrect_size_computation") & any_of(blob, weak), "specialize_pattern"),
    ], "keep_pattern_signal")


def primary_action(recommended: Column, confidence: Column, relations: Column, candidate_actions: Column, pattern_actions: Column, blob: Column, assessment: Column, bug_class: Column, high: tuple[str, ...] = HIGH_VALUE, symptom: tuple[str, ...] = SYMPTOMS, weak: tuple[str, ...] = LOCATION_DOUBTS, context: tuple[str, ...] = AROUND) -> Column:
    """What is to be done with a record, from what its candidates need."""
    has = lambda c, v: truthy(F.array_contains(c, v))
    return ladder([
        ((recommended == "manual_review") & (confidence < 0.55), "manual_review_due_to_weak_evidence"),
        (has(candidate_actions, "replace_candidate") | any_of(blob, symptom), "demote_symptoms_and_search_upstream"),
        (has(relations, "outside_patched_files") & any_of(blob, weak), "rerun_slice_from_patch_context"),
        (assessment.isin("overbroad", "wrong", "insufficient_evidence") | has(pattern_actions, "specialize_pattern"), "specialize_root_cause_pattern"),
        (any_of(blob, context), "expand_interprocedural_context"),
        (recommended == "keep_with_lower_confidence", "retain_but_lower_confidence"),
        (bug_class.isin(*high), "rerun_slice_from_patch_context"),
    ], "manual_review")


def priority(confidence: Column, action: Column, bug_class: Column, candidate_actions: Column, blob: Column, high: tuple[str, ...] = HIGH_VALUE) -> Column:
    """0 to 100: how soon a record is worth the work."""
    has = lambda *v: truthy(F.arrays_overlap(candidate_actions, F.array(*map(F.lit, v))))
    add = lambda c, v: F.when(truthy(c), v).otherwise(0.0)
    score = F.coalesce(confidence, F.lit(0.0)) * 45.0 + add(bug_class.isin(*high), 18.0) + add(action.isin(*PATCH_ACTIONS, "specialize_root_cause_pattern"), 20.0)
    score = score + add(has("retain_candidate", "promote_for_recheck"), 10.0) + add(has("replace_candidate"), 8.0) - add(any_of(blob, ("vague", "insufficient", "not enough")), 15.0)
    return F.round(clamp(score, 0.0, 100.0), 2)


def bucket(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def start_locations(causes: DataFrame, record: str = "cve_id", most: int = 5) -> DataFrame:
    """At most `most` causes of a record (rank, relation, action) to start again from; if all are noise, the first ones anyway."""
    keep = F.col("relation").isin(*NEAR_PATCH, "same_file_as_patch") | (F.coalesce("action", F.lit("")) != "demote_symptom_or_noise")
    marked = causes.withColumn("_keep", truthy(keep)).withColumn("_any", F.max("_keep").over(W.partitionBy(record)))
    some = marked.where(F.col("_keep") | ~F.col("_any")).withColumn("reason", F.when(F.col("_any"), F.coalesce("action", F.lit("recheck"))).otherwise("fallback_existing_candidate"))
    at = F.row_number().over(W.partitionBy(record).orderBy("rank"))
    return some.withColumn("_at", at).where(F.col("_at") <= most).drop("_at", "_keep", "_any")


def query_terms(terms: Column, issues: Column, most: int = 16) -> Column:
    """Sorted distinct terms, and words of four letters or more of the issues, as tokens."""
    found = F.flatten(F.transform(issues, lambda i: F.regexp_extract_all(i, F.lit("[A-Za-z][A-Za-z0-9_]{3,}"), F.lit(0))))
    token = lambda t: F.array_join(F.filter(F.split(F.translate(F.lower(F.trim(t)), "- ", "__"), "_"), lambda x: x != ""), "_")
    every = F.array_distinct(F.transform(F.filter(F.concat(terms, found), lambda t: t.isNotNull()), token))
    return F.slice(F.array_sort(F.filter(every, lambda t: ~t.isin("unknown", "none", ""))), 1, most)


def rescored(candidates: DataFrame, actions: DataFrame, record: str = "cve_id") -> DataFrame:
    """bonus, penalty and refined_score of candidates after the plan for their record and place.

    candidates: record, file, line, function, score, pattern and the flags of the patch's neighbourhood; actions:
    record, seq, file, line, function, old_refinement, old_pattern, primary_action, specific. The first action at a
    candidate's place counts; an action without a function fits any. With bug_class and query_terms (array) in
    actions, candidates of that class are lifted too.
    """
    c, a = candidates.alias("c"), actions.alias("a")
    here = (F.col(f"c.{record}") == F.col(f"a.{record}")) & (F.col("c.file") == F.col("a.file")) & (F.col("c.line") == F.col("a.line"))
    fits = F.col("a.function").isNull() | F.col("c.function").isNull() | (F.col("a.function") == F.col("c.function"))
    key = [f"c.{record}", "c.file", "c.line", "c.function"]
    first = c.join(a, here & fits).groupBy(*key).agg(F.min_by(F.struct("a.old_refinement", "a.old_pattern"), "a.seq").alias("old"))
    classed = {"bug_class", "query_terms"} <= set(actions.columns)
    more = [F.min_by(c, "seq").alias(f"_{c}") for c in ("bug_class", "query_terms") if classed]
    by_record = actions.groupBy(record).agg(F.min_by("primary_action", "seq").alias("primary_action"), *more)
    same = lambda n: F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    both = candidates.alias("x").join(first.alias("y"), same(record) & same("file") & same("line") & same("function"), "left").select("x.*", "y.old").join(by_record, record, "left")
    flag = lambda c, v: F.when(truthy(F.col(c)), v).otherwise(0.0)
    old = F.col("old.old_refinement")
    bonus = F.when(old == "retain_candidate", 0.22).when(old == "promote_for_recheck", 0.14).otherwise(0.0)
    bonus = bonus + flag("patch_anchor_overlap", 0.08) + flag("defines_value_later_fixed", 0.08) + flag("missing_check_replaced", 0.08) + flag("incorrect_computation_replaced", 0.07)
    bonus = bonus + F.when(truthy(F.col("same_function_as_patch")), 0.12).when(truthy(F.col("same_file_as_patch")), 0.06).otherwise(0.0)
    if classed:  # the class that the record is thought to be of shows in the plan's words or the candidate's pattern
        meant = F.array_contains("_query_terms", F.col("_bug_class")) | F.contains(F.col("pattern"), F.col("_bug_class"))
        bonus = bonus + F.when(truthy(F.col("_bug_class").isin(*HIGH_VALUE) & meant), 0.05).otherwise(0.0)
    outside = ~truthy(F.col("same_function_as_patch")) & ~truthy(F.col("same_file_as_patch")) & truthy(F.col("primary_action").isin(*PATCH_ACTIONS))
    penalty = F.when(old.isin("replace_candidate", "demote_symptom_or_noise"), 0.32).otherwise(0.0) + F.when(outside, 0.08).otherwise(0.0)
    penalty = penalty + F.when(truthy(F.col("old.old_pattern") == "specialize_pattern") & F.coalesce("pattern", F.lit("")).isin(*GENERIC), 0.05).otherwise(0.0)
    return both.select(*candidates.columns, F.round(bonus, 4).alias("bonus"), F.round(penalty, 4).alias("penalty"), F.round(clamp(F.col("score") + bonus - penalty), 6).alias("refined_score"))


def refined_topk(rows: DataFrame, record: str = "cve_id", least: float = 0.5, k: int = 3) -> DataFrame:
    """The k best of a record at or above `least`; if there is none, the k best. Ties: bonus, score, then the earlier line."""
    good = F.max((F.col("refined_score") >= least).cast("int")).over(W.partitionBy(record))
    order = W.partitionBy(record).orderBy(F.desc("refined_score"), F.desc("bonus"), F.desc("score"), "line", "file")
    kept = rows.withColumn("_good", good).where((F.col("_good") == 0) | (F.col("refined_score") >= least))
    return kept.withColumn("refined_rank", F.row_number().over(order)).where(F.col("refined_rank") <= k).drop("_good")


def dataset_rows(causes: DataFrame, validation: DataFrame, record: str = "cve_id") -> DataFrame:
    """Causes (record, rank, label) that a validation (record, ranks) allows, numbered anew; without an allowed one the first cause stays."""
    both = causes.join(validation.select(record, "ranks"), record)
    allowed = truthy(F.array_contains("ranks", F.col("rank")) & F.coalesce(F.col("label").isin("root_cause", "plausible_root_cause"), F.lit(True)))
    marked = both.withColumn("_ok", allowed).withColumn("_any", F.max("_ok").over(W.partitionBy(record))).withColumn("_first", F.min("rank").over(W.partitionBy(record)))
    kept = marked.where(F.col("_ok") | (~F.col("_any") & (F.col("rank") == F.col("_first"))))
    return kept.withColumn("new_rank", F.row_number().over(W.partitionBy(record).orderBy("rank"))).drop("ranks", "_ok", "_any", "_first")
