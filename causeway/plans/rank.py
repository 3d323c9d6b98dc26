"""From slice graphs to ranked candidates and chains, for many reports in one job.

Inputs are tables keyed by bug_id:
  nodes  bug_id, node_id, file, line, func, text, statement_types, tracked_entities, defined, referenced, calls, memory, is_trigger
  edges  bug_id, source, target, relation, entity, approximated
  reports bug_id, bug_type
  frames bug_id, file, line, function (optional)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators import graph, scoring
from causeway.operators.joins import best_match, small
from causeway.operators.ranking import backfill_topk, promote_best, topk
from causeway.rules import ladder, truthy

_NAMES = T.ArrayType(T.StringType())
NODES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("bug_id", "node_id", "file")]
    + [T.StructField("line", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("func", "text")]
    + [T.StructField(n, _NAMES) for n in ("statement_types", "tracked_entities", "defined", "referenced", "calls", "memory")]
    + [T.StructField("is_trigger", T.BooleanType())]
)
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("bug_id", "source", "target", "relation", "entity")] + [T.StructField("approximated", T.BooleanType())])
REPORTS = T.StructType([T.StructField(n, T.StringType()) for n in ("bug_id", "bug_type", "project")])
FRAMES = T.StructType([T.StructField(n, T.StringType()) for n in ("bug_id", "file")] + [T.StructField("line", T.IntegerType()), T.StructField("function", T.StringType())])
#: Order in which relations are followed.
RELATION_ORDER = ("data_dependence", "integer_influence", "call_argument", "return_value", "state_update", "allocation_site", "deallocation_site", "initialization_site", "heap_object", "global_state", "control_dependence", "caller_context")


def features(nodes: DataFrame, edges: DataFrame, reports: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """The columns that score_candidates() wants, a row a node."""
    links = edges.select(F.col("bug_id").alias("g"), F.col("source").alias("src"), F.col("target").alias("dst"))
    ends = nodes.where("is_trigger").select(F.col("bug_id").alias("g"), F.col("node_id").alias("node"))
    far = graph.distances(links, ends).select(F.col("g").alias("bug_id"), F.col("node").alias("node_id"), "distance")
    most = far.groupBy("bug_id").agg(F.greatest(F.max("distance"), F.lit(1)).alias("most"))
    out = edges.groupBy("bug_id", F.col("source").alias("node_id")).agg(F.count("*").alias("outgoing_edge_count"), F.sort_array(F.collect_set("relation")).alias("out"))
    into = edges.groupBy("bug_id", F.col("target").alias("node_id")).agg(F.count("*").alias("incoming_edge_count"), F.sort_array(F.collect_set("relation")).alias("into"))
    place = nodes.where("is_trigger").select("bug_id", F.col("file").alias("t_file"), F.col("line").alias("t_line"))
    key = ["bug_id", "node_id"]
    df = nodes.join(out, key, "left").join(into, key, "left").join(far, key, "left").join(most, "bug_id", "left").join(place, "bug_id", "left").join(reports, "bug_id", "left")
    none = F.array().cast(_NAMES)
    df = df.select("*", F.lower("text").alias("low")).withColumns({c: F.coalesce(c, none) for c in ("out", "into", "statement_types", "tracked_entities", "defined", "referenced", "calls", "memory")})
    met = lambda c, kinds: truthy(F.arrays_overlap(c, F.array(*map(F.lit, kinds))))
    text = F.col("text")
    df = df.withColumns({"outgoing_edge_count": F.coalesce("outgoing_edge_count", F.lit(0)), "incoming_edge_count": F.coalesce("incoming_edge_count", F.lit(0))})
    far = F.coalesce("distance", "most", F.lit(1))
    is_ = lambda k: F.array_contains("statement_types", k)
    df = df.withColumns({
        "distance_to_trigger": far,
        "distance_score": F.round(F.least(far / F.coalesce("most", F.lit(1)), F.lit(1.0)), 4),
        "module_proximity_score": scoring.proximity(F.col("file"), F.col("t_file")),
        "defines_value_used_later": met(F.col("out"), scoring.VALUE_RELATIONS),
        "changes_object_state": is_("memory_operation") | met(F.col("out"), scoring.STATE_RELATIONS) | scoring.updates_state(text),
        "affects_control_flow": is_("condition") | met(F.col("out"), ("control_dependence",)),
        "has_integer_influence": met(F.col("out"), ("integer_influence",)) | scoring.computes_integer(text),
        "writes_through_output_parameter": scoring.writes_output(text),
        "has_memory_context": (F.size("memory") > 0) | F.col("low").contains("malloc") | F.col("low").contains("free") | F.col("low").contains("delete"),
        "is_return_statement": is_("return"),
        "is_trigger_node": truthy(F.col("is_trigger")),
        "state_origin_score": F.when(F.col("incoming_edge_count") == 0, 1.0).otherwise(0.0),
    })
    forwards = (F.size("calls") > 0) & scoring.updates_state(text) & ~F.col("is_return_statement") & ~F.col("has_integer_influence") & ~F.col("affects_control_flow") & ~F.col("has_memory_context")
    used = ~F.col("defines_value_used_later") & ~F.col("changes_object_state") & ~F.col("affects_control_flow") & (F.size("defined") == 0) & (F.col("incoming_edge_count") > 0)
    names = F.transform(F.array_union("tracked_entities", "referenced"), F.lower)
    df = df.withColumns({"is_call_forwarding_statement": forwards, "pure_use_site": F.col("is_trigger_node") | used, "names": names})
    found = scoring.pattern_match(F.col("low"), F.col("names"), F.col("out"), F.col("into"), F.col("affects_control_flow"), F.col("has_integer_influence"), F.col("has_memory_context"), F.col("writes_through_output_parameter"), F.col("bug_type"))
    df = df.withColumn("_m", found).withColumns({"matched_bug_pattern": F.col("_m.pattern"), "bug_pattern_score": F.round("_m.score", 4), "operation": scoring.operation_type(F.col("low"), F.col("affects_control_flow"), F.col("has_integer_influence"), F.col("has_memory_context"), F.col("changes_object_state"))})
    at_trigger = (F.col("file") == F.col("t_file")) & (F.col("line") == F.col("t_line"))
    if frames is None:
        support = F.when(truthy(at_trigger), 0.85).otherwise(0.0)
    else:
        exact = frames.select("bug_id", "file", "line").distinct().withColumn("_exact", F.lit(0.8))
        same = frames.where("function is not null").select("bug_id", F.col("function").alias("func")).distinct().withColumn("_same", F.lit(0.35))
        df = df.join(exact, ["bug_id", "file", "line"], "left").join(same, ["bug_id", "func"], "left")
        support = F.greatest(F.when(truthy(at_trigger), 0.85).otherwise(0.0), F.coalesce("_exact", F.lit(0.0)), F.coalesce("_same", F.lit(0.0)))
    return df.withColumn("runtime_support_score", support).drop("_m", "out", "into", "distance", "most", "t_file", "t_line", "_exact", "_same")


def with_pattern_prior(df: DataFrame, library: DataFrame) -> DataFrame:
    """Adds cve_pattern_prior_score from a library (pattern_id, category, operation_type, support_count, confidence, templates), lifts bug_pattern_score by it."""
    lib = library.select("pattern_id", F.lower(F.trim("category")).alias("category"), "operation_type", "support_count", "confidence", "templates")
    top = lib.agg(F.max("support_count").alias("max_support"))
    lib = lib.crossJoin(F.broadcast(top))
    wanted = df.where(~F.col("matched_bug_pattern").isin("none", "unknown", "")).withColumn("words", F.filter(F.split(F.translate("low", "_", " "), r"\s+"), lambda x: F.length(x) > 2))
    parts = lambda c: F.array_distinct(F.filter(F.split(F.translate(c, "_", " "), r"\s+"), lambda x: F.length(x) > 2))
    text = lambda e: scoring.template_score(F.array_distinct("words"), F.transform(e["templates"], parts))
    score = lambda e: scoring.prior_score(F.col("matched_bug_pattern") == e["category"], F.col("operation") == e["operation_type"], e["support_count"], e["max_support"], e["confidence"], text(e))
    best = best_match(wanted.select("bug_id", "node_id", "matched_bug_pattern", "operation", "words"), lib, [("matched_bug_pattern", "category"), ("operation", "operation_type")], score, ["bug_id", "node_id"], ["pattern_id"])
    out = df.join(best.select("bug_id", "node_id", F.col("score").alias("cve_pattern_prior_score"), F.col("pattern_id").alias("cve_pattern_id")), ["bug_id", "node_id"], "left").na.fill(0.0, ["cve_pattern_prior_score"])
    return out.withColumn("bug_pattern_score", F.round(F.least(F.col("bug_pattern_score") + 0.12 * F.col("cve_pattern_prior_score"), F.lit(1.0)), 4))


def with_project_prior(df: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds project_prior_score: the best of a project's shares (project, key, share) for the pattern, operation and bug type."""
    keys = df.select("bug_id", "node_id", F.lower("project").alias("project"), F.explode(F.array(F.lower("matched_bug_pattern"), F.lower("operation"), F.lower("bug_type"))).alias("key"))
    best = keys.join(small(priors.select(F.lower("project").alias("project"), F.lower("key").alias("key"), "share")), ["project", "key"]).groupBy("bug_id", "node_id").agg(F.max("share").alias("s"))
    return df.join(best.select("bug_id", "node_id", F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)).alias("project_prior_score")), ["bug_id", "node_id"], "left").na.fill(0.0, ["project_prior_score"])


def rank(scored: DataFrame, k: int = 5, threshold: float = 0.15) -> DataFrame:
    """The first k candidates of each report: label, score, line, all falling; groups without a root cause promote their best."""
    ready = promote_best(scored, ["bug_id"], "label", scoring.ROOT, "score", ["file", "line", "node_id"], ~F.col("is_trigger_node"))
    order = [F.desc(scoring.label_priority(F.col("label"))), F.desc("score"), F.desc("line"), "file", "node_id"]
    return backfill_topk(ready, ["bug_id"], order, "score", threshold, k)


def candidates(nodes: DataFrame, edges: DataFrame, reports: DataFrame, frames: DataFrame | None = None, library: DataFrame | None = None, priors: DataFrame | None = None, calibration: scoring.Calibration | None = None, k: int = 5, threshold: float = 0.15) -> DataFrame:
    df = features(nodes, edges, reports, frames)
    if library is not None:
        df = with_pattern_prior(df, library)
    if priors is not None:
        df = with_project_prior(df, priors)
    return rank(scoring.score_candidates(df, calibration=calibration), k, threshold)


def chains(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, max_chains: int = 5, max_paths: int = 3, max_depth: int = 12) -> DataFrame:
    """(bug_id, rank, root_node, path, relations, score): paths from candidates to the trigger, the best first.

    A candidate without a path is joined to the trigger directly; the trigger itself makes a chain of one step.
    """
    order = ladder([(F.col("relation") == r, i) for i, r in enumerate(RELATION_ORDER)], 99)
    links = edges.select(F.col("bug_id").alias("g"), F.col("source").alias("src"), F.col("target").alias("dst"), "relation")
    starts = ranked.where("not is_trigger_node").select(F.col("bug_id").alias("g"), F.col("node_id").alias("node"))
    ends = nodes.where("is_trigger").select(F.col("bug_id").alias("g"), F.col("node_id").alias("node"))
    found = graph.bounded_paths(links, starts, ends, max_depth, max_paths, order).select(F.col("g").alias("bug_id"), F.col("start").alias("node_id"), "path")
    goal = ends.select(F.col("g").alias("bug_id"), F.col("node").alias("goal"))
    alone = ranked.select("bug_id", "node_id").join(found.select("bug_id", "node_id").distinct(), ["bug_id", "node_id"], "left_anti").join(goal, "bug_id")
    direct = alone.select("bug_id", "node_id", F.when(F.col("node_id") == F.col("goal"), F.array("node_id")).otherwise(F.array("node_id", "goal")).alias("path"))
    both = found.unionByName(direct).join(ranked.select("bug_id", "node_id", F.col("rank").alias("root_rank"), F.col("score").alias("root_score"), "label", "runtime_support_score"), ["bug_id", "node_id"])
    hops = both.select("bug_id", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "source")).withColumn("target", F.get("path", F.col("pos") + 1))
    first = edges.withColumn("_p", order).groupBy("bug_id", "source", "target").agg(F.min_by("relation", F.struct("_p", "relation")).alias("relation"), F.min_by("approximated", F.struct("_p", "relation")).alias("approximated"))
    steps = hops.join(first, ["bug_id", "source", "target"], "left").groupBy("bug_id", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", scoring.step_relation(F.coalesce("relation", F.lit("data_dependence"))).alias("r")))), lambda x: x["r"]).alias("relations"), F.count_if(F.coalesce("approximated", F.lit(True))).alias("approximated")
    )
    df = both.join(steps, ["bug_id", "path"], "left").withColumn("relations", F.coalesce("relations", F.array().cast(_NAMES)))
    crosses = F.arrays_overlap("relations", F.array(F.lit("call_argument"), F.lit("return_value")))
    df = df.withColumn("score", scoring.chain_score(F.col("root_score"), F.size("path") - 1, F.size(F.array_distinct("relations")), crosses, F.col("runtime_support_score") > 0, F.coalesce("approximated", F.lit(0)), F.col("label"), max_depth))
    one = df.dropDuplicates(["bug_id", "path"])
    out = topk(one, ["bug_id"], [F.desc("score"), "root_rank", F.size("path"), F.array_join("path", ">")], max_chains)
    return out.select("bug_id", "rank", F.col("node_id").alias("root_node"), "root_rank", "path", "relations", F.round("score", 4).alias("score"))


def refine_with_patch(ranked: DataFrame, diff: DataFrame, intent: DataFrame) -> DataFrame:
    """Candidates re-ranked by a fix patch: diff (bug_id, file, line, function, text), intent (bug_id, intent).

    Ties go to the lower line here. The patch only lifts scores that are there already.
    """
    exact = diff.select("bug_id", "file", "line").distinct().withColumn("_e", F.lit(True))
    same = diff.where("function is not null").select("bug_id", "file", F.col("function").alias("func")).distinct().withColumn("_s", F.lit(True))
    changed = diff.where("function is not null").select("bug_id", F.col("function").alias("func")).distinct().withColumn("_c", F.lit(True))
    said = diff.select("bug_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z_]\w*"), F.lit(0))).alias("w")).groupBy("bug_id").agg(F.collect_set("w").alias("_w"))
    df = ranked.join(exact, ["bug_id", "file", "line"], "left").join(same, ["bug_id", "file", "func"], "left").join(changed, ["bug_id", "func"], "left").join(said, "bug_id", "left").join(intent.select("bug_id", "intent"), "bug_id", "left")
    mine = F.array_distinct(F.concat(F.transform("tracked_entities", F.lower), F.array_compact(F.array(F.lower("func")))))
    both = F.size(F.array_intersect(mine, F.coalesce("_w", F.array().cast(_NAMES))))
    df = df.withColumn("patch_alignment_score", scoring.patch_alignment(truthy(F.col("_e")), truthy(F.col("_s")), truthy(F.col("_c")), both, F.lit(False), F.coalesce("intent", F.lit("unknown")), F.col("label")))
    df = df.withColumn("score", F.least(F.col("score") + scoring.patch_boost(F.col("patch_alignment_score")), F.lit(1.0))).drop("_e", "_s", "_c", "_w", "rank")
    return topk(df, ["bug_id"], [F.desc(scoring.label_priority(F.col("label"))), F.desc("score"), "line", "file", "node_id"], 1 << 30)


def chains_with_patch(chains: DataFrame, before: DataFrame, after: DataFrame, hits: DataFrame, intent: DataFrame) -> DataFrame:
    """Chains (bug_id, rank, root_rank, score) after a patch: re-ranked by score, ties as they stood.

    A chain's root is found by its rank among the old candidates, its node, and that node's new rank; hits: (bug_id,
    rank, n), the steps of a chain that the patch touches.
    """
    old = before.select("bug_id", F.col("rank").alias("root_rank"), "node_id")
    new = after.select("bug_id", "node_id", F.col("rank").alias("_new"), F.col("patch_alignment_score").alias("_a"))
    both = chains.join(old, ["bug_id", "root_rank"], "left").join(new, ["bug_id", "node_id"], "left").join(hits.select("bug_id", "rank", F.col("n").alias("_n")), ["bug_id", "rank"], "left").join(intent.select("bug_id", "intent"), "bug_id", "left")
    align, n = F.coalesce("_a", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    boost = F.least(align * 0.08, F.lit(0.12)) + F.least(0.04 * n, F.lit(0.12)) + F.when(truthy(F.col("intent") == "direct_fix") & F.col("_new").isNotNull(), 0.04).otherwise(0.0)
    lifted = both.select("bug_id", F.col("rank").alias("old_rank"), F.coalesce("_new", "root_rank").alias("root_rank"), F.round(F.least(F.col("score") + boost, F.lit(1.0)), 6).alias("score"), F.round(F.least(align + 0.08 * n, F.lit(1.0)), 4).alias("alignment"), ((n > 0) | (align >= 0.3)).alias("patch_supported"))
    return topk(lifted, ["bug_id"], [F.desc("score"), "old_rank"], 1 << 30)
