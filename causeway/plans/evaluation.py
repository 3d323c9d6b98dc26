"""Evaluation logs: the best record of each case, distributions, bins, success rates, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import aggregates as A
from causeway.operators.ranking import diversify, keep_best
from causeway.rules import is_not, ladder, truthy

EDGES = (0.70, 0.80, 0.85, 0.90, 0.95, 0.99)


def record_quality(completed: Column, patched: Column, compared: Column, judged: Column) -> Column:
    """How much a record of a case says."""
    on = lambda c, v: F.when(truthy(c), v).otherwise(0)
    return on(completed, 100) + on(patched, 20) + on(compared, 15) + on(judged, 10)


def best_records(rows: DataFrame, key: str = "local_id", quality: str = "quality", seconds: str = "elapsed_seconds", seq: str = "seq") -> DataFrame:
    """One record a case: the highest quality, the longest run, the last one on a tie."""
    return keep_best(rows, [key], [F.desc(quality), F.desc_nulls_last(seconds), F.desc(seq)])


def verdicts(rows: DataFrame) -> DataFrame:
    """(verdict, n); missing verdicts count under the name None."""
    return A.distribution(rows, F.col("verdict"), "verdict", missing="None")


def bins(rows: DataFrame) -> DataFrame:
    """(dataset, bin, verdict, n)."""
    return rows.groupBy("dataset", A.bins(F.col("confidence"), EDGES).alias("bin"), "verdict").agg(F.count("*").alias("n"))


def success_rates(rows: DataFrame, by: list[str], claims: tuple[str, ...], verdict: tuple[str, ...]) -> DataFrame:
    return A.success(rows, by, F.col("claim").isin(*claims), F.col("verdict").isin(*verdict))


def strict(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """Cases where everything speaks for the generated patch; what isn't known doesn't speak against it."""
    return rows.where((F.col("status") == "completed") & (F.col("claim") == "generated_preferred") & (F.col("confidence") >= least) & is_not(F.col("is_pseudo_patch"), True) & is_not(F.col("cuts_root"), False) & is_not(F.col("safe"), False))


def suspicious(rows: DataFrame, bad: tuple[str, ...]) -> DataFrame:
    return rows.where((F.col("status") == "completed") & truthy(F.col("verdict").isin(*bad) | (F.col("reference_cuts") == False)))  # noqa: E712


def selection(rows: DataFrame, per_project: int = 2, limit: int = 30) -> DataFrame:
    """Targets for a dynamic run: by score, a few of each project."""
    return diversify(rows, ["project"], [F.desc("score"), "local_id"], per_project, limit)


def dynamic_verdict(base_built: Column, base_crashed: Column, generated: Column, reference: Column) -> Column:
    """What a run of base, generated and reference patch shows; generated and reference say whether the crash is gone."""
    return ladder(
        [
            (~truthy(base_built), "base_build_failed"),
            (~truthy(base_crashed), "base_not_triggered"),
            (truthy(generated) & truthy(reference), "both_fix"),
            (truthy(generated) & (reference == False), "generated_only"),  # noqa: E712
            (truthy(reference) & (generated == False), "reference_only"),  # noqa: E712
            ((generated == False) & (reference == False), "neither_fixes"),  # noqa: E712
            (truthy(generated), "generated_fixes_reference_unknown"),
            (truthy(reference), "reference_fixes_generated_unknown"),
        ],
        "inconclusive",
    )


def apply_failure(stderr: Column) -> Column:
    """Why a patch couldn't be applied."""
    e = F.lower(stderr)
    return ladder([(e.isNull() | (e == ""), "none"), (e.contains("corrupt patch") | e.contains("malformed"), "malformed_patch"), (e.contains("no such file") | e.contains("does not exist"), "missing_file"), (e.contains("patch does not apply") | e.contains("hunk failed") | e.contains("patch failed"), "context_mismatch")], "other")


def judged_confidence(model: Column, reasoning: Column, density: Column, agrees: Column, fallback: Column) -> Column:
    """A model's confidence, corrected by what it rests on."""
    quality = ladder([(F.length(reasoning) >= 160, 1.0), (F.length(reasoning) >= 60, 0.7), (F.length(reasoning) > 0, 0.4)], 0.0)
    total = 0.55 * model + 0.15 * quality + 0.15 * density + F.when(agrees.isNull(), 0.05).when(agrees, 0.1).otherwise(-0.15) - F.when(truthy(fallback), 0.35).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def prediction_quality(rows: DataFrame, text: str = "prediction") -> DataFrame:
    """One row: how many predictions there are, are not blank, are encoded, look like diffs, or like code."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.split(t, r"\W+")
    code = F.arrays_overlap(words, F.array(*map(F.lit, ("if", "return", "for", "while", "malloc", "free", "sizeof"))))
    diff = t.startswith("diff --git") | (t.contains("--- ") & t.contains("+++ ") & t.contains("@@"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.trim(t) != "").alias("nonempty"), F.count_if(t.contains("<S2SV_")).alias("encoded"), F.count_if(diff).alias("diff_like"), F.count_if(code).alias("code_like"))


def keep_recommended(records: DataFrame, validations: DataFrame, key: str, drop: bool = False) -> DataFrame:
    """Records with what a validation recommends; one without a validation is kept. With drop, what isn't to be kept goes."""
    said = validations.groupBy(key).agg(F.max_by("recommended_action", "confidence").alias("recommended_action"))
    out = records.join(said, key, "left").withColumn("recommended_action", F.coalesce("recommended_action", F.lit("not_validated")))
    out = out.withColumn("keep", F.col("recommended_action").isin("keep", "keep_with_lower_confidence", "not_validated"))
    return out.where("keep") if drop else out


def validation_summary(validations: DataFrame) -> DataFrame:
    """(label, recommended_action, n, kept, confidence) over validations."""
    kept = F.col("recommended_action").isin("keep", "keep_with_lower_confidence")
    return validations.groupBy("label", "recommended_action").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.round(F.avg("confidence"), 4).alias("confidence"))


def variants(results: DataFrame, parts: list[str]) -> DataFrame:
    """Each result once whole and once without each of the parts, for ablation."""
    out = results.withColumn("variant", F.lit("full"))
    for p in parts:
        out = out.unionByName(results.withColumn(p, F.lit(None).cast(results.schema[p].dataType)).withColumn("variant", F.lit(f"without_{p}")))
    return out
