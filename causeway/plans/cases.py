"""Raw case descriptions to normalised reports: a JSON text per row in, one row with typed parts out.

A description may be flat or nested, and evidence may stand in it or come from what was parsed elsewhere. All of it
is one projection over a table of cases; what is parsed from traces is joined by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import traces
from causeway.rules import truthy

#: Keys that may stand at the top of a description, by the part they belong to.
BUILD = ("build_cmd", "build_dir", "compile_commands_path")
RUN = ("cmd", "poc_path", "env")
RUNTIME = ("sanitizer_report_path", "stack_trace_path", "runtime_log_path", "core_path", "execution_trace_path")
PATCH = ("fix_commit", "diff_path", "issue_text", "issue_text_path", "commit_message", "commit_message_path", "regression_test_path")
PLACE = ("file", "line", "column", "end_line", "end_column", "function", "snippet")
#: Words that mark a piece of evidence as one about the trigger.
TRIGGER_WORDS = ("summary", "frame", "error header")
_CONFIG = "map<string,string>"


def overlay(*layers: Column) -> Column:
    """Maps laid over each other; of a key's values the last layer's one that is there counts. Null layers say nothing."""
    none = F.create_map().cast(_CONFIG)
    out = F.coalesce(layers[0], none)
    for layer in layers[1:]:
        out = F.map_zip_with(out, F.coalesce(layer, none), lambda _, a, b: F.coalesce(b, a))
    return out


def _at(path: str, text: str = "spec") -> Column:
    return F.get_json_object(text, f"$.{path}")


def config_of(text: str, fields: list[str]) -> Column:
    """A description's settings: those in config, else in analysis_config, else those of `fields` at the top."""
    nested = F.from_json(F.coalesce(_at("config", text), _at("analysis_config", text)), _CONFIG)
    top = F.map_filter(F.from_json(F.col(text), _CONFIG), lambda k, _: k.isin(*fields))
    return F.coalesce(nested, top)


def lifted(cases: DataFrame, text: str = "spec") -> DataFrame:
    """Build, run, runtime, patch and trigger as structs, flat keys lifted into them.

    Of build, what stands at the top wins; of the others, what is nested does, but for run_cmd. A trigger's place
    is its location, or the keys of a place that the trigger itself has.
    """
    both = lambda part, keys, top_first=False: F.struct(*((F.coalesce(_at(k, text), _at(f"{part}.{k}", text)) if top_first else F.coalesce(_at(f"{part}.{k}", text), _at(k, text))).alias(k) for k in keys))
    run = F.struct(F.coalesce(_at("run_cmd", text), _at("run.cmd", text), _at("cmd", text)).alias("cmd"), *(F.coalesce(_at(f"run.{k}", text), _at(k, text)).alias(k) for k in RUN[1:]))
    nested = _at("trigger_point.location", text).isNotNull()
    place = lambda k: F.when(nested, _at(f"trigger_point.location.{k}", text)).otherwise(_at(f"trigger_point.{k}", text))
    numbers = ("line", "column", "end_line", "end_column")
    trigger = F.struct(*((place(k).try_cast("int") if k in numbers else place(k)).alias(k) for k in PLACE), _at("trigger_point.operation", text).alias("operation"), _at("trigger_point.bug_type_hint", text).alias("bug_type_hint"), _at("trigger_point.confidence", text).try_cast("double").alias("confidence"))
    return cases.select("*", both("build", BUILD, True).alias("build"), run.alias("run"), both("runtime_evidence", RUNTIME).alias("runtime"), both("patch_evidence", PATCH).alias("patch"), trigger.alias("trigger"))


def inline_evidence(cases: DataFrame, text: str = "spec") -> DataFrame:
    """sanitizer_report, stack_trace and runtime_log that stand in a description; blank ones don't count, and a log only counts in its part."""
    said = lambda path: F.when(F.trim(_at(path, text)) != "", _at(path, text))
    return cases.select(
        "*",
        F.coalesce(said("runtime_evidence.sanitizer_report"), said("sanitizer_report")).alias("sanitizer_report"),
        F.coalesce(said("runtime_evidence.stack_trace"), said("stack_trace")).alias("stack_trace"),
        said("runtime_evidence.runtime_log").alias("runtime_log"),
    )


def runtime_merge(cases: DataFrame, case_id: str = "case_id") -> DataFrame:
    """(case_id, summary, access, bug_type, frames, linked) from the evidence in descriptions.

    Frames of the sanitizer's report stand before those of the trace; equal ones are kept once. linked: those with a place.
    """
    texts = cases.select(case_id, F.explode(F.array(F.struct(F.lit(0).alias("source"), F.col("sanitizer_report").alias("content")), F.struct(F.lit(1).alias("source"), F.col("stack_trace").alias("content")))).alias("t")).select(case_id, "t.*").where("content is not null")
    frame = F.struct("index", "function", "file", "line", "column", "module", "instruction")
    frames = traces.frames(texts, [case_id, "source"], "content").select(case_id, F.struct("source", "line_no", frame.alias("frame")).alias("f"))
    grouped = frames.groupBy(case_id).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["frame"])).alias("frames"))
    told = traces.sanitizer(texts.where("source = 0"), [case_id], "content").select(case_id, "summary", "access", "bug_type")
    out = cases.select(case_id).join(told, case_id, "left").join(grouped, case_id, "left")
    return out.withColumn("linked", F.filter("frames", lambda f: f["file"].isNotNull()))


def trigger_merge(cases: DataFrame, runtime: DataFrame, case_id: str = "case_id") -> DataFrame:
    """The trigger of each case: what it says itself, and function, column and bug type from the first frame with a place where it doesn't."""
    first = F.get("linked", F.lit(0))
    both = cases.join(runtime.select(case_id, first.alias("_first"), F.col("bug_type").alias("_bug")), case_id, "left")
    said = lambda k: F.coalesce(F.nullif(F.col(f"trigger.{k}"), F.lit("")), F.col(f"_first.{k}"))
    filled = F.struct(
        said("file").alias("file"),
        F.coalesce(F.nullif("trigger.line", F.lit(0)), "_first.line").alias("line"),
        F.coalesce("trigger.column", "_first.column").alias("column"),
        said("function").alias("function"),
        F.col("trigger.operation").alias("operation"),
        F.coalesce("trigger.bug_type_hint", "_bug").alias("bug_type_hint"),
        F.col("trigger.confidence").alias("confidence"),
    )
    return both.withColumn("trigger", filled).drop("_first", "_bug")


def trigger_evidence(descriptions: Column) -> Column:
    """The descriptions that speak of the trigger."""
    return F.filter(descriptions, lambda d: truthy(F.exists(F.array(*map(F.lit, TRIGGER_WORDS)), lambda w: F.contains(F.lower(d), w))))


def reject_missing(parts: DataFrame, files: DataFrame, part: str = "path", kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(what is there, what isn't with its reason): paths against a listing of the landing folder (path, is_dir)."""
    seen = files.select(F.col("path").alias(part), F.col("is_dir").alias("_dir")).dropDuplicates([part])
    both = parts.join(seen, part, "left")
    wants_dir = F.col(kind) == "directory"
    reason = F.when(F.col("_dir").isNull(), "missing").when(wants_dir & ~F.col("_dir"), "not_a_directory").when(~wants_dir & F.col("_dir"), "not_a_file")
    judged = both.withColumn("reason", reason).drop("_dir")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def normalise(cases: DataFrame, text: str = "spec", case_id: str = "case_id") -> DataFrame:
    """All of the above for a table of descriptions: a row a case."""
    ready = inline_evidence(lifted(cases, text), text)
    runtime = runtime_merge(ready, case_id)
    return trigger_merge(ready, runtime, case_id).join(runtime, case_id, "left")
