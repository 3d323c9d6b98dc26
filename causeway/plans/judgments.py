"""What a model said, as tables: prompts and their keys out, replies in, with a fallback where there is none.

No model is called here. A prompt's hash is the key under which a landing job stores the reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.rules import clamp, ladder

#: Labels of a candidate in replies, and what they stand for.
LABELS = {"root_cause": "root_cause_candidate", "propagation": "propagation", "symptom": "symptom"}
INTENTS = ("direct_fix", "defensive_guard", "compensating_check", "cleanup", "refactor", "unknown")
VERDICTS = ("accept", "accept_with_lower_confidence", "manual_review", "reject")
QUALITIES = ("strong_improvement", "plausible_improvement", "plausible_but_broad", "no_clear_improvement", "likely_wrong")
MERGES = ("replace_original", "append_as_alternative", "do_not_merge")
ASSESSMENTS = ("root_cause", "plausible_root_cause", "propagation", "symptom_or_noise", "uncertain")
#: Weights of the parts of a calibrated confidence.
CALIBRATION = {"model": 0.55, "reasoning": 0.15, "evidence": 0.15, "patch": 0.05, "parsed": 0.1, "unparsed": -0.15, "fallback": -0.35}


def prompt(*parts: tuple[str, Column]) -> Column:
    """A deterministic text of named parts, in the given order."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts)))


def prompt_key(task: str, payload: Column) -> Column:
    return F.sha2(F.concat(F.lit(task + "\n"), payload), 256)


def choice(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """A token of a closed set, or the default."""
    t = T.token(F.coalesce(value, F.lit("")), default)
    return F.when(t.isin(*allowed), t).otherwise(F.lit(default))


def confidence(value: Column) -> Column:
    return clamp(F.coalesce(value.try_cast("double"), F.lit(0.0)))


def cut(c: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of them dots if something went."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit - 3)), F.lit("..."))).otherwise(c)


def reply(raw: Column) -> Column:
    """struct(label, reasoning, confidence) of the first object in a reply; null if there is none."""
    found = T.json_object(T.without_fence(raw))
    part = lambda k: F.get_json_object(found, f"$.{k}")
    return F.when(found.isNotNull(), F.struct(F.lower(F.trim(part("label"))).alias("label"), F.trim(part("reasoning")).alias("reasoning"), part("confidence").try_cast("double").alias("confidence")))


def reasoning_quality(reasoning: Column) -> Column:
    n = F.length(F.trim(F.coalesce(reasoning, F.lit(""))))
    return F.when(n < 25, 0.25).when(n < 80, 0.55).otherwise(0.85)


def evidence_density(lines: Column, diff_lines: Column) -> Column:
    """Eight lines of source, or forty of a diff, are full evidence."""
    return F.least(F.greatest(lines / 8.0, diff_lines / 40.0), F.lit(1.0))


def calibrated(raw: Column, reasoning: Column, density: Column, used_patch: Column, parsed: Column, fallback: Column) -> Column:
    w = CALIBRATION
    parts = w["model"] * clamp(F.coalesce(raw, F.lit(0.45))) + w["reasoning"] * reasoning_quality(reasoning) + w["evidence"] * clamp(density)
    parts = parts + F.when(used_patch, w["patch"]).otherwise(0.0) + F.when(parsed, w["parsed"]).otherwise(w["unparsed"]) + F.when(fallback, w["fallback"]).otherwise(0.0)
    return clamp(parts)


def candidate_judgments(candidates: DataFrame, replies: DataFrame, key: str = "prompt_key") -> DataFrame:
    """Candidates (label being the heuristic one) with verdict, reasoning, fallback and calibrated confidence.

    A reply without a known label, or none at all, leaves the heuristic label. Of repeated replies the first by text counts.
    """
    one = replies.groupBy(key).agg(F.min("reply").alias("_reply"))
    both = candidates.join(one, key, "left").withColumn("_r", reply(F.col("_reply")))
    verdict = ladder([(F.col("_r.label") == k, v) for k, v in LABELS.items()])
    both = both.withColumn("_v", verdict).withColumn("fallback", F.col("_v").isNull())
    used = F.coalesce(F.col("used_patch"), F.lit(False)) if "used_patch" in candidates.columns else F.lit(False)
    density = F.col("evidence_density") if "evidence_density" in candidates.columns else F.lit(0.0)
    score = calibrated(F.when(~F.col("fallback"), F.col("_r.confidence")), F.col("_r.reasoning"), density, used, ~F.col("fallback"), F.col("fallback"))
    return both.select(*candidates.columns, F.coalesce("_v", "label").alias("verdict"), F.coalesce("_r.reasoning", F.lit("")).alias("reasoning"), "fallback", F.round(score, 6).alias("judged_confidence"))


def validated(replies: DataFrame, least: float = 0.65) -> DataFrame:
    """Second-pass replies (id, verdict, merge, confidence, assessments array<struct<rank,label,confidence>>, best array<string>) normalised, with whether they pass.

    The best ranks are those that are named, or else the first three of likely assessments. At most eight assessments and five ranks stay.
    """
    item = lambda x: F.struct(x["rank"].try_cast("int").alias("rank"), choice(x["label"], ASSESSMENTS, "uncertain").alias("label"), confidence(x["confidence"]).alias("confidence"))
    items = F.filter(F.transform(F.coalesce("assessments", F.array().cast("array<struct<rank:string,label:string,confidence:string>>")), item), lambda x: x["rank"].isNotNull())
    named = F.array_distinct(F.filter(F.transform(F.coalesce("best", F.array().cast("array<string>")), lambda r: r.try_cast("int")), lambda r: r.isNotNull()))
    likely = F.slice(F.transform(F.filter("items", lambda x: x["label"].isin("root_cause", "plausible_root_cause") & (x["confidence"] >= 0.55)), lambda x: x["rank"]), 1, 3)
    rows = replies.select("id", choice(F.col("verdict"), VERDICTS, "manual_review").alias("verdict"), choice(F.col("merge"), MERGES, "do_not_merge").alias("merge"), confidence(F.col("confidence")).alias("confidence"), items.alias("items"), named.alias("named"))
    rows = rows.withColumn("ranks", F.when(F.size("named") > 0, F.col("named")).otherwise(likely))
    passed = F.col("verdict").isin(*VERDICTS[:2]) & (F.col("merge") != "do_not_merge") & (F.col("confidence") >= least) & (F.size("ranks") > 0)
    return rows.select("id", "verdict", "merge", "confidence", F.slice("items", 1, 8).alias("assessments"), F.slice("ranks", 1, 5).alias("ranks"), passed.alias("passed"))


def mean_of_known(*parts: Column) -> Column:
    """The mean of those that aren't null, within 0 and 1; 0 if none is there."""
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.round(clamp(F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)), 6)


def quality_label(value: Column) -> Column:
    return choice(value, QUALITIES, "no_clear_improvement")


def accepted_report(judged: DataFrame, label: str = "accept", least: float = 0.8) -> DataFrame:
    """(dimension, value, n) over accepted rows: verdict, merge, and bins of confidence."""
    kept = judged.where((F.col("verdict") == label) & (F.col("confidence") >= least))
    parts = F.array(F.struct(F.lit("verdict").alias("dimension"), F.col("verdict").alias("value")), F.struct(F.lit("merge").alias("dimension"), F.col("merge").alias("value")), F.struct(F.lit("confidence").alias("dimension"), F.format_number(F.floor(F.col("confidence") * 10) / 10, 1).alias("value")))
    return kept.select(F.explode(parts).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))
