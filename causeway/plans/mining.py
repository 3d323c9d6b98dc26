"""From advisories and annotations to patterns, priors and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from causeway.functions import text, urls
from causeway.operators import aggregates as A
from causeway.operators.ranking import numbered, topk
from causeway.rules import any_of, ladder


def fix_commits(references: DataFrame) -> DataFrame:
    """(cve_id, sha, url): commits named by references (cve_id, pos, url), each once with its first URL."""
    r = references.withColumn("p", urls.parsed(urls.repaired(F.col("url")))).where("p.commit_sha is not null")
    return r.groupBy("cve_id", F.col("p.commit_sha").alias("sha")).agg(F.min_by("url", "pos").alias("url"))


def repository(references: DataFrame) -> DataFrame:
    """(cve_id, repo_url, votes): the repository most references speak for."""
    r = references.withColumn("p", urls.parsed(urls.repaired(F.col("url")))).where("p.repo_url is not null").withColumn("repo_url", F.col("p.repo_url"))
    return A.vote(r, ["cve_id"], "repo_url", urls.vote_weight(F.col("p.kind")))


def merged(records: DataFrame) -> DataFrame:
    """One record a CVE id from several sources (cve_id, seq, description, language, project, cwes, references)."""
    both = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]))).alias(c)
    return records.groupBy("cve_id").agg(A.longest("description").alias("description"), A.first_known("language", F.col("seq")).alias("language"), A.first_known("project", F.col("seq")).alias("project"), both("cwes"), both("references"))


def operation(pattern, snippet):
    """What kind of code an annotation is about, from its pattern's name, then its snippet."""
    p, s = F.lower(pattern), F.lower(snippet)
    size = p.contains("size") | p.contains("length") | any_of(s, text.SIZES)
    return ladder(
        [
            (p.contains("null") | any_of(s, sorted(text.NULLS)), "null_check"),
            (p.contains("overflow") & p.contains("integer"), "integer_overflow"),
            (size & any_of(s, sorted(text.COPIES)), "size_to_copy"),
            (size, "length_calculation"),
            (p.contains("lifetime") | p.contains("use_after_free") | any_of(s, sorted(text.FREES)), "lifetime_management"),
            (p.contains("initialization"), "initialization"),
            (p.contains("guard") | p.contains("check"), "guard_check"),
        ],
        "state_update",
    )


def patterns(annotations: DataFrame, min_support: int = 2, examples: int = 8, templates: int = 5) -> DataFrame:
    """A library from annotations (cve_id, pattern, code_snippet, signature, confidence): groups of one category, operation and graph signature.

    pattern_id follows falling support, then the key. Templates come by frequency, examples by confidence.
    """
    o = annotations.select("cve_id", text.token(F.col("pattern")).alias("category"), operation(F.col("pattern"), F.col("code_snippet")).alias("operation_type"), F.coalesce("signature", F.lit("")).alias("signature"), text.template(F.col("code_snippet")).alias("template"), "confidence")
    key = ["category", "operation_type", "signature"]
    head = o.groupBy(*key).agg(F.count("*").alias("support_count"), F.countDistinct("cve_id").alias("cves"), F.round(F.avg("confidence"), 4).alias("confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence")).where(F.col("support_count") >= min_support)
    top = topk(o.groupBy(*key, "template").agg(F.count("*").alias("n")), key, [F.desc("n"), "template"], templates)
    top = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "template"))), lambda x: x["template"]).alias("templates"))
    best = topk(o.select(*key, "cve_id", "confidence").distinct(), key, [F.desc("confidence"), "cve_id"], examples)
    best = best.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cve_id"))), lambda x: x["cve_id"]).alias("examples"))
    return numbered(head, [F.desc("support_count"), *key], "pattern_id").join(top, key).join(best, key)


def feature_rules(rows: DataFrame, key: list[str], features: list[str], share: float = 0.6) -> DataFrame:
    """(key, feature, value, share): values that at least `share` of a group's rows agree on."""
    long = rows.select(*key, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))).alias("f")).select(*key, "f.feature", "f.value")
    return A.modal(long, [*key, "feature"], "value", share).select(*key, "feature", F.col("mode").alias("value"), "share")


def project_priors(cases: DataFrame, min_support: int = 2) -> DataFrame:
    """(project, kind, key, share) from cases (project, pattern, operation, bug_type)."""
    long = cases.select(F.lower("project").alias("project"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lower(k).alias("key")) for k in ("pattern", "operation", "bug_type")))).alias("x")).select("project", "x.kind", "x.key").where("key is not null")
    counts = long.groupBy("project", "kind", "key").agg(F.count("*").alias("n"))
    total = cases.groupBy(F.lower("project").alias("project")).agg(F.count("*").alias("t")).where(F.col("t") >= min_support)
    of = F.sum("n").over(W.partitionBy("project", "kind"))
    return counts.join(total, "project").select("project", "kind", "key", F.round(F.col("n") / of, 4).alias("share"))


def calibration(cases: DataFrame, pattern_cap: float = 0.08) -> DataFrame:
    """(pattern, boost) of patterns by how often they come."""
    return A.boosts(cases.where("pattern is not null"), "pattern", pattern_cap)
