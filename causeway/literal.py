"""Queries over literal inputs for the plans on cases, records, judgments and refinement, with their expected rows.

The expected rows were taken from a run and then looked over against the inputs; DuckDB gets them as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.fixtures import DEBUGGER, TRACE, diff_parse
from causeway.functions import diffs, text, traces
from causeway.operators import scoring
from causeway.plans import cases, cves, evaluation, judgments, rank, refinement
from causeway.sources import readers

SPECS = [
    ("c1", '{"build_cmd":"make","build":{"build_cmd":"old","build_dir":"out"},"run_cmd":"./a","cmd":"./b","stack_trace_path":"t.txt","runtime_evidence":{"stack_trace_path":"own.txt"},"fix_commit":"abc","sanitizer_report":%s,"trigger_point":{"file":"lib/store.c","line":41,"operation":"write"}}' % __import__("json").dumps(TRACE)),
    ("c2", '{"run":{"cmd":"./c"},"cmd":"./d","stack_trace":%s,"runtime_evidence":{"sanitizer_report":"  "},"trigger_point":{"location":{"file":"app/main.c","line":12,"column":5,"function":"main"},"bug_type_hint":"use_after_free"}}' % __import__("json").dumps(DEBUGGER)),
    ("c3", '{"trigger_point":{"file":"x.c"}}'),
    ("c4", None),
]


def case_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cases.normalise(spark.createDataFrame(SPECS, "case_id string, spec string"))
    return out.select("case_id", F.col("build.build_cmd").alias("build_cmd"), F.col("build.build_dir").alias("build_dir"), F.col("run.cmd").alias("cmd"), F.col("runtime.stack_trace_path").alias("trace_path"), F.col("patch.fix_commit").alias("fix_commit"), F.col("trigger.file").alias("file"), F.col("trigger.line").alias("line"), F.col("trigger.column").alias("col"), F.col("trigger.function").alias("function"), F.col("trigger.bug_type_hint").alias("hint"), "summary", "access", F.coalesce(F.size("linked"), F.lit(0)).alias("places"))


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", '{"config":{"top_k":"5","seed":"1"}}', '{"top_k":"7"}', '{"seed":"2"}'), ("b", '{"analysis_config":{"top_k":"5"}}', None, None), ("c", '{"top_k":"3","other":"x"}', None, '{"seed":"9"}')]
    df = spark.createDataFrame(rows, "case_id string, spec string, overlay string, cli string")
    merged = cases.overlay(cases.config_of("spec", ["top_k", "seed"]), F.from_json("overlay", "map<string,string>"), F.from_json("cli", "map<string,string>"))
    return df.select("case_id", merged.alias("m")).select("case_id", F.try_element_at("m", F.lit("top_k")).alias("top_k"), F.try_element_at("m", F.lit("seed")).alias("seed"), F.size("m").alias("n"))


def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.createDataFrame([("c1", "a.diff", "file"), ("c1", "out", "directory"), ("c2", "gone", "file"), ("c3", "out", "file"), ("c3", "a.diff", "directory")], "case_id string, path string, kind string")
    files = spark.createDataFrame([("a.diff", False), ("out", True)], "path string, is_dir boolean")
    good, bad = cases.reject_missing(parts, files)
    return good.withColumn("reason", F.lit("kept")).unionByName(bad)


def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("n1", "symptom", "k1", True, 1.0), ("n2", "propagation", "k2", False, 0.5), ("n3", "symptom", "k3", False, 0.0), ("n4", "propagation", "k4", False, 0.0)]
    replies = [("k1", 'Sure: {"label": " Root_Cause ", "reasoning": "it writes past the end of the buffer", "confidence": 0.9}'), ("k2", "no object here"), ("k3", '```json\n{"label": "symptom", "reasoning": "short", "confidence": "0.5"}\n```'), ("k3", '~{"label": "propagation"}')]
    df = spark.createDataFrame(rows, "node_id string, label string, prompt_key string, used_patch boolean, evidence_density double")
    return judgments.candidate_judgments(df, spark.createDataFrame(replies, "prompt_key string, reply string")).drop("prompt_key", "label")


def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("n1", "free(p);", 3), ("n2", None, 4)], "node_id string, code string, line int")
    payload = judgments.prompt(("code", F.col("code")), ("line", F.col("line")))
    return df.select("node_id", payload.alias("payload"), judgments.prompt_key("label", payload).alias("prompt_key"))


def validated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("a", "Accept", "replace_original", "0.9", [("2", "Root Cause", "0.8"), ("x", "propagation", "1"), ("1", "Symptom or noise", "0.9")], None),
        ("b", "accept_with_lower_confidence", "append-as-alternative", "7", [], ["3", "3", "y", "1"]),
        ("c", "what?", None, "nan?", [("1", "plausible_root_cause", "0.6")], None),
        ("d", "accept", "do_not_merge", "0.9", None, ["1"]),
    ]
    df = spark.createDataFrame(rows, "id string, verdict string, merge string, confidence string, assessments array<struct<rank:string,label:string,confidence:string>>, best array<string>")
    out = judgments.validated(df)
    return out.select("id", "verdict", "merge", "confidence", F.array_join(F.transform("assessments", lambda x: F.concat_ws("/", x["rank"].cast("string"), x["label"])), ",").alias("assessments"), F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"), "passed")


HIGH, WEAK, SYMPTOM, CONTEXT = ("buffer_overflow", "use_after_free"), ("wrong file", "far away"), ("only a symptom",), ("caller",)


def refinement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("r1", "keep", 0.9, "buffer_overflow", "fine", "looks right", [("correct", "patched_statement", None, None, "missing_check")]),
        ("r2", "keep", 0.8, "logic", "overbroad", "is too vague", [("", "outside_patched_files", "valid_but_broad", None, "none")]),
        ("r3", "manual_review", 0.5, "logic", "fine", "", [("uncertain", "same_file_as_patch", None, "drop", "unknown")]),
        ("r4", "keep", 0.6, "logic", "fine", "the place is far away", [("", "outside_patched_files", None, None, "unknown")]),
        ("r5", "keep_with_lower_confidence", None, "logic", "fine", "", [("", None, None, None, "other")]),
    ]
    df = spark.createDataFrame(rows, "cve_id string, recommended string, confidence double, bug_class string, assessment string, blob string, causes array<struct<label:string,relation:string,plabel:string,paction:string,pattern:string>>")
    each = df.select("*", F.posexplode("causes").alias("at", "c"))
    each = each.withColumn("ca", refinement.candidate_action(F.col("c.label"), F.col("c.relation"), F.col("blob"), WEAK)).withColumn("pa", refinement.pattern_action(F.col("c.plabel"), F.col("c.paction"), F.col("c.pattern"), F.col("blob"), WEAK))
    one = each.groupBy("cve_id", "recommended", "confidence", "bug_class", "assessment", "blob").agg(F.collect_list("ca").alias("cas"), F.collect_list("pa").alias("pas"), F.collect_list("c.relation").alias("relations"))
    one = one.withColumn("action", refinement.primary_action(F.col("recommended"), F.col("confidence"), F.col("relations"), F.col("cas"), F.col("pas"), F.col("blob"), F.col("assessment"), F.col("bug_class"), HIGH, SYMPTOM, WEAK, CONTEXT))
    one = one.withColumn("priority", refinement.priority(F.col("confidence"), F.col("action"), F.col("bug_class"), F.col("cas"), F.col("blob"), HIGH))
    return one.select("cve_id", F.array_join("cas", ",").alias("candidates"), F.array_join("pas", ",").alias("patterns"), "action", "priority", refinement.bucket(F.col("priority")).alias("bucket"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("r1", ["Buffer-Overflow", "none", None], ["The size is wrong", "see size_t"]), ("r2", [], [])], "cve_id string, terms array<string>, issues array<string>")
    return df.select("cve_id", F.array_join(refinement.query_terms(F.col("terms"), F.col("issues")), ",").alias("terms"))


def rescored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [("r", "a.c", 5, "f", 0.5, "none", True, True, True, False, False, False), ("r", "a.c", 9, "g", 0.6, "none", False, False, True, True, False, True), ("r", "b.c", 1, None, 0.4, "unknown", False, False, False, False, True, False), ("s", "a.c", 5, "f", 0.2, "x", False, False, False, False, False, False)]
    a = [("r", 1, "a.c", 5, "f", "retain_candidate", "keep_pattern_signal", "rerun_slice_from_patch_context"), ("r", 2, "a.c", 9, "other", "promote_for_recheck", "specialize_pattern", "x"), ("r", 3, "b.c", 1, None, "replace_candidate", "specialize_pattern", "x"), ("r", 4, "b.c", 1, None, "retain_candidate", "x", "x")]
    cd = spark.createDataFrame(c, "cve_id string, file string, line int, function string, score double, pattern string, patch_anchor_overlap boolean, same_function_as_patch boolean, same_file_as_patch boolean, defines_value_later_fixed boolean, missing_check_replaced boolean, incorrect_computation_replaced boolean")
    ad = spark.createDataFrame(a, "cve_id string, seq int, file string, line int, function string, old_refinement string, old_pattern string, primary_action string")
    out = refinement.refined_topk(refinement.rescored(cd, ad), least=0.5, k=2)
    return out.select("cve_id", "file", "line", "bonus", "penalty", "refined_score", "refined_rank")


def refinement_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("r", 1, "patched_statement", "demote_symptom_or_noise"), ("r", 2, "outside_patched_files", "demote_symptom_or_noise"), ("r", 3, "outside_patched_files", None), ("s", 1, "outside_patched_files", "demote_symptom_or_noise")]
    return refinement.start_locations(spark.createDataFrame(rows, "cve_id string, rank int, relation string, action string")).select("cve_id", "rank", "reason")


def refined_dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = spark.createDataFrame([("r", 1, "symptom"), ("r", 2, None), ("r", 3, "root_cause"), ("s", 4, "symptom"), ("s", 7, None), ("t", 1, None)], "cve_id string, rank int, label string")
    checked = spark.createDataFrame([("r", [3, 1, 2]), ("s", [9])], "cve_id string, ranks array<int>")
    return refinement.dataset_rows(causes, checked).select("cve_id", "rank", "new_rank")


def record_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("v1", "C++", None, "https://h.org/o/lib", [], [], ["CWE-1"], "a thing", ["ab"], ["commit"], [("cpe:x", "<2")]),
        ("v2", None, "", None, [None, "prod"], ["pack"], ["CWE-787"], "a thing", [], ["compare"], [(None, "<2"), ("", None)]),
        ("v3", None, "proj", "https://h.org/hint/x", [], [], [], "has a Heap Overflow", None, ["other"], []),
        ("v4", "rust", None, None, [], [], [], "web page", None, [], []),
    ]
    df = spark.createDataFrame(rows, "cve_id string, lang string, project string, repo string, products array<string>, packages array<string>, cwes array<string>, text string, commits array<string>, kinds array<string>, versions array<struct<cpe_uri:string,range:string>>")
    hints = F.create_map(F.lit("https://h.org/hint/x"), F.lit("c"))
    df = df.withColumn("language", cves.infer_language(F.col("lang"), hints, F.col("repo"), F.col("project")))
    return df.select("cve_id", "language", cves.infer_project(F.col("project"), F.col("repo"), F.col("products"), F.col("packages")).alias("name"), cves.relevant(F.col("language"), F.col("cwes"), F.col("text"), ("CWE-787", "CWE-416"), ("heap overflow",)).alias("relevant"), F.size(cves.trace_notes(F.col("repo"), F.col("language"), F.col("commits"), F.col("kinds"))).alias("notes"), F.array_join(cves.version_sources(F.col("versions")), ",").alias("sources"), F.array_join(cves.description_words(F.col("text")), ",").alias("words"))


def fix_commit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("v", "aa", "u1", None, 1.0, "reference_commit", "u1"), ("v", "aa", "u2", "Fix", 0.95, "normalized_fix_commit", None), ("v", "bb", None, None, 0.95, "normalized_fix_commit", None), ("v", "cc", None, "x", 0.95, "normalized_fix_commit", "u9"), ("w", "dd", None, None, 0.25, "keyword_search", None)]
    out = cves.fix_commits(spark.createDataFrame(rows, "record string, commit_sha string, url string, summary string, score double, matched_by string, evidence_url string"), most=2)
    return out.select("record", "rank", "commit_sha", "url", "summary", "score", F.array_join("matched_by", ",").alias("matched_by"), F.array_join("evidence_urls", ",").alias("evidence"))


def patch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("p1", "add", "if (n > size) return;", "Fix it", "d", "unknown"), ("p2", "add", "if (p == NULL)", "x", "d", "unknown"), ("p3", "del", "a = b;", "Rename things", "d", "unknown"),
        ("p4", "add", "x = y;", "style", "d", "unknown"), ("p5", "add", "free(p);", "bounds", "overflow", "unknown"), ("p6", "add", "a = b;", "fix", "d", "unknown"), ("p7", "context", "a = b;", "x", "d", "cleanup"),
        ("p7", "add", "call()", "x", "d", "cleanup"), ("p8", "add", "call()", "x", "d", "defensive_guard"),
    ]
    return cves.patch_type(spark.createDataFrame(rows, "patch_id string, kind string, text string, message string, description string, intent string"), ["patch_id"], "message", "description", "intent")


def _old_statements(spark: SparkSession) -> DataFrame:
    rows = [("lib/store.c", "put_bytes", 39, "    int room = n + 1;"), ("lib/store.c", "put_bytes", 40, "    char *to = grow(p, room);"), ("lib/store.c", "main", 90, "    int room = n + 1;"), ("lib/store.c", "main", 93, "run(room);")]
    return spark.createDataFrame(rows, "file string, func string, line int, text string")


def patch_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("p1", "lib/store.c", 1, 38, 4, "put_bytes", ["int room = n * 4 + 1;"], ["int  room = n + 1"], "{"),
        ("p2", "lib/store.c", 1, 60, 2, None, [], ["run(room)"], ""),
        ("p3", "lib/store.c", 1, 39, 2, None, ["check(room, to);"], [], "x"),
        ("p4", "lib/store.c", 1, 39, 2, None, [], [], "char *to = grow(p, room);\n{"),
        ("p5", "lib/store.c", 1, 92, 1, None, [], ["gone();"], ""),
        ("p6", "lib/none.c", 2, 0, 0, None, ["a();"], [], ""),
    ]
    hunks = spark.createDataFrame(rows, "patch_id string, file string, hunk int, old_start int, old_count int, function string, added array<string>, removed array<string>, before string")
    return cves.anchors(hunks, _old_statements(spark), ["patch_id"]).drop("hunk")


def anchor_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", ["x = 1;", "FREE(p); memcpy(a, b)"], "Heap Use-After-Free"), ("b", ["strncpy(a)", "free(a)"], "NULL pointer dereference"), ("c", [], "an out-of-bounds read")]
    df = spark.createDataFrame(rows, "id string, texts array<string>, text string")
    return df.select("id", cves.anchor_operation(F.col("texts")).alias("operation"), cves.described_bug(F.col("text")).alias("bug"), F.array_join(F.array_sort(cves.names_of(F.array_join("texts", " "))), ",").alias("names"))


def patch_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [("v", 1, "a.c", 5, "f", ["N"], True, False, False, None), ("v", 2, "a.c", 30, "f", ["n"], True, True, True, None), ("v", 3, "a.c", 50, "g", [], False, False, True, None), ("v", 4, "b.c", 2, "h", [], False, True, False, "upstream_slice"), ("v", 5, "b.c", 3, "h", [], False, False, False, None), ("v", 6, "a.c", 12, "f", [], False, False, False, None), ("v", 7, "a.c", 70, "", [], False, False, False, None)]
    cd = spark.createDataFrame(c, "cve_id string, id int, file string, line int, func string, tracked_entities array<string>, defines_value_used_later boolean, affects_control_flow boolean, has_integer_influence boolean, candidate_origin string")
    anchor = spark.createDataFrame([("v", "a.c", 30, "f", ["n", "m"], "bounds_fix")], "cve_id string, file string, line int, func string, entities array<string>, patch_type string")
    hunks = spark.createDataFrame([("v", "a.c", "f", 10, 4), ("v", "a.c", None, 28, 4)], "cve_id string, file string, function string, old_start int, old_count int")
    out = cves.augmented(cd, anchor, ["cve_id"])
    out = cves.patch_relation(out, anchor, hunks, ["cve_id"])
    return out.select("id", "patch_anchor_overlap", "same_file_as_patch", "same_function_as_patch", "defines_value_later_fixed", "missing_check_replaced", "incorrect_computation_replaced", "upstream_from_patch", "patch_relation")


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = spark.createDataFrame([("lib/store.c", "put_bytes", 37, 45), ("lib/store.c", "main", 80, 99)], "file string, func string, line int, end_line int")
    return cves.changed_places(diff_parse(spark, sf_dir), _old_statements(spark), functions, ["patch_id"]).select("kind", "line", "func", F.trim("text").alias("text"))


def hunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.hunks(diff_parse(spark, sf_dir), ["patch_id"]).select("patch_id", "file", "old_start", "function", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


def pattern_library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "size", "length", 5), (2, "size", "guard", 9), (3, "guard", "guard", 2)]
    return cves.library_summary(spark.createDataFrame(rows, "pattern_id int, category string, operation_type string, support_count long"))


def initial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("is_trigger_node", "pure_use_site", "defines_value_used_later", "changes_object_state", "affects_control_flow", "is_return_statement", "is_call_forwarding_statement")
    rows = [
        ("a", 0, 0.9, "none", ["x"], [True] + [False] * 6), ("b", 1, 0.9, "none", [], [False, True, True] + [False] * 4), ("c", 3, 0.9, "none", [], [False, False, True, False, False, True, False]),
        ("d", 1, 0.55, "size", ["x", "y", "z"], [False, False, False, False, True, False, False]), ("e", 2, 0.1, "none", [], [False, False, False, True, False, False, False]), ("f", 1, 0.1, "size", [], [False, False, True, False, False, False, False]),
    ]
    df = spark.createDataFrame(rows, "id string, distance int, bug_pattern_score double, pattern string, entities array<string>, flags array<boolean>")
    f = {n: F.col("flags")[i] for i, n in enumerate(names)} | {"distance": F.col("distance"), "bug_pattern_score": F.col("bug_pattern_score"), "cve_pattern_prior_score": F.lit(0.0), "expert_rca_prior_score": F.lit(None).cast("double")}
    return df.select("id", scoring.initial_label(f).alias("label"), "pattern", "entities").select("id", "label", scoring.explanation(F.col("label"), F.col("pattern"), F.col("entities")).alias("explanation"))


def expert_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [("n1", "Integer Overflow", "unknown", ["size", "copy"], 0.5), ("n2", "none", "free_call", ["zzz"], 0.99), ("n3", "none", "", ["nothing"], 0.3), ("n4", "odd", "odd", ["size", "copy", "more", "else"], 0.2)]
    e = [("e1", ["incorrect_size_computation"], ["length_calculation"], ["size", "buffer"], 0.9), ("e2", ["ownership_or_lifetime_operation"], ["ownership_transfer"], ["copy"], 0.5)]
    out = scoring.expert_matches(spark.createDataFrame(c, "id string, pattern string, operation string, words array<string>, pattern_score double"), spark.createDataFrame(e, "entry_id string, categories array<string>, operations array<string>, words array<string>, confidence double"), ["id"])
    return out.select("id", "expert_id", "expert_rca_prior_score", F.round("pattern_score", 6).alias("pattern_score"))


def patched_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = spark.createDataFrame([("b", 1, 1, 0.8), ("b", 2, 2, 0.8), ("b", 3, 3, 0.5), ("c", 1, 1, 0.99)], "bug_id string, rank int, root_rank int, score double")
    before = spark.createDataFrame([("b", 1, "n1"), ("b", 2, "n2"), ("c", 1, "m1")], "bug_id string, rank int, node_id string")
    after = spark.createDataFrame([("b", 1, "n2", 0.5), ("b", 2, "n1", 0.0), ("c", 1, "m1", 1.0)], "bug_id string, rank int, node_id string, patch_alignment_score double")
    hits = spark.createDataFrame([("b", 2, 2), ("b", 3, 9)], "bug_id string, rank int, n int")
    return rank.chains_with_patch(chains, before, after, hits, spark.createDataFrame([("b", "direct_fix"), ("c", "unknown")], "bug_id string, intent string"))


REPORT = "Fuzz Target: png_fuzz x\nCrash State:\n  read_chunk\n  # skipped\n  ns::Image<T>::load(int)\n\nother\nhttps://oss.example/download?testcase_id=123456&x\n"


def crash_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("a", REPORT), ("b", "Crash State:\nonly"), ("c", None), ("d", "Crash state:\nf\nSanitizer: address")], "id string, report string")
    return df.select("id", F.array_join(traces.crash_state(F.col("report")), ",").alias("state"), traces.fuzz_target(F.col("report")).alias("target"), traces.testcase_id(F.col("report")).alias("testcase"))


def function_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("ns::Image<T>::load(int)",), ("int run",), ("plain",)], "name string")
    return df.select("name", F.array_join(traces.name_variants(F.col("name")), "|").alias("variants"))


def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("diff --git a b",), (" ",), (None,), ("<S2SV_start> if (x) return;",), ("--- a\n+++ b\n@@ 1",), ("freedom iffy",)]
    return evaluation.prediction_quality(spark.createDataFrame(rows, "prediction string"))


def kept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("v4",)], "cve_id string")
    said = spark.createDataFrame([("v1", "valid", "keep", 0.4), ("v1", "valid", "drop", 0.3), ("v2", "noisy", "drop", 0.9), ("v3", "broad", "keep_with_lower_confidence", 0.5)], "cve_id string, label string, recommended_action string, confidence double")
    return evaluation.keep_recommended(records, said, "cve_id")


def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("valid", "keep", 0.5), ("valid", "keep", 0.8), ("noisy", "drop", None), ("valid", "manual_review", 0.1)]
    return evaluation.validation_summary(spark.createDataFrame(rows, "label string, recommended_action string, confidence double"))


def ablation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.variants(spark.createDataFrame([(1, "c", "p")], "id int, chains string, candidates string"), ["chains", "candidates"])


def repository_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.createDataFrame([("v1", "u1", "p1"), ("v2", "u1", "p1"), ("v3", "u9", "p1"), ("v4", None, None)], "cve_id string, repo_url string, project string")
    by_cve = spark.createDataFrame([("v1", "/own")], "cve_id string, path string")
    return cves.repo_path(records, by_cve, spark.createDataFrame([("u1", "/url"), ("p1", "/project")], "name string, path string"))


def case_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", ["none", "own_pattern"], "x"), ("b", [], "Uninitialized size"), ("c", None, "double-free"), ("d", ["unknown"], "a NULL thing"), ("e", [], "odd")]
    p = cves.case_pattern(F.coalesce("matched", F.array().cast("array<string>")), F.col("text"))
    return spark.createDataFrame(rows, "id string, matched array<string>, text string").select("id", p.alias("pattern")).select("id", "pattern", cves.case_operation(F.col("pattern")).alias("operation"))


def unfixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "a\n#ifdef MAGMA_ENABLE_FIXES\nfixed\n#else\nbroken\n#endif\n# ifndef MAGMA_ENABLE_FIXES\nold\n#endif\n#ifdef OTHER\nb\n#endif\n"
    df = spark.createDataFrame([("s", source), ("n", None)], "id string, source string")
    return df.select("id", F.replace(text.unfixed("source"), F.lit("\n"), F.lit("|")).alias("source"))


def feed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    return readers.records(nvd=frame(FEEDS), project=frame(['{"cve_id":"cve-2021-4","project":"p","cwes":["cwe-20"],"references":["hxxp://h/x"]}'])).select("cve_id", "description", F.array_join("cwes", ",").alias("cwes"), F.array_join("references", ",").alias("refs"), "project", "source_kind")


FEEDS = [
    '{"vulnerabilities":[{"cve":{"id":"CVE-2021-1","descriptions":[{"lang":"en","value":"new"}],"weaknesses":[{"description":[{"value":"CWE-416"}]}],"references":[{"url":"https://h/1"}],"configurations":[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:v:p:1.0:*"}],"children":[{"cpeMatch":[{"criteria":"cpe:2.3:a:v:q:*:*"}]}]}]}]}}]}',
    '{"CVE_Items":[{"cve":{"CVE_data_meta":{"ID":"CVE-2021-2"},"description":{"description_data":[{"lang":"en","value":"old"}]},"problemtype":{"problemtype_data":[{"description":[{"value":"CWE-787"}]}]},"references":{"reference_data":[{"url":"www.h.org"}]}},"configurations":{"nodes":[{"children":[{"cpe_match":[{"cpe23Uri":"cpe:2.3:a:w:r:2:*"},{"cpe23Uri":"cpe:2.3:a:w:r:2:*"}]}]}]}},{"cve":{}}]}',
    "not json",
]


def feed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.affected(spark.createDataFrame([(x,) for x in FEEDS], "v string"), "v")


QUERIES = {
    f.__name__: f
    for f in (case_reports, config_overlay, artifact_check, judged_candidates, prompt_keys, validated_replies, refinement_plan, query_terms, rescored_candidates, refinement_starts, refined_dataset_rows, record_inference, fix_commit_candidates, patch_types, patch_anchors, anchor_traits, patch_relations, changed_lines, hunk_parts, pattern_library_summary, initial_labels, expert_prior, patched_chains, crash_reports, function_name_variants, prediction_counts, kept_records, validation_counts, ablation_variants, repository_paths, case_patterns, unfixed_sources, feed_records, feed_products)
}
