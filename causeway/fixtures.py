"""Queries over literal inputs: parsers, the ranking plan and incremental reading, which no driver table fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import diffs, lexer, text, traces, urls
from causeway.operators import scoring
from causeway.plans import rank as plan
from causeway.streaming import resume

TRACE = """==1==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x602000000011
WRITE of size 4 at 0x602000000011 thread T0
    #0 0x4f1a2b in put_bytes /work/lib/store.c:41:9
    #1 0x4f1c00 in handle (/work/app+0x4f1c00)
    #2 0x4f1d11 in main /work/app/main.c:12
SUMMARY: AddressSanitizer: heap-buffer-overflow /work/lib/store.c:41:9 in put_bytes
"""
DEBUGGER = "#0  put_bytes (n=4) at lib/store.c:41\n#1  main () at app/main.c:12:3\nframe #2: at walk (lib/tree.c:7:1)\nnothing here\n"
PATCH = """diff --git a/lib/store.c b/lib/store.c
--- a/lib/store.c
+++ b/lib/store.c
@@ -38,4 +38,6 @@ static int put_bytes(char *p, int n)
 {
-    int room = n + 1;
+    int room = n * 4 + 1;
+    if (room < n)
+        return -1;
     char *to = grow(p, room);
 }
"""
SOURCE = """/* store { */
static int room_for(int count, int width) {
    int total = count * width; // no check
    return total;
}

char *grow(char *p, int len)
{
    char *to = realloc(p, len);
    if (to == NULL) {
        return NULL;
    }
    memset(to, 0, len);
    return to;
}
"""


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("b1", TRACE), ("b2", DEBUGGER), ("b3", ""), ("b4", None)], "bug_id string, content string")


def frame_parse(spark, sf_dir):
    return traces.frames(_texts(spark), ["bug_id"], "content")


def sanitizer_parse(spark, sf_dir):
    return traces.sanitizer(_texts(spark), ["bug_id"], "content")


def diagnostics_parse(spark, sf_dir):
    rows = [("b1", "cc -c x.c\nlib/x.c:12:5: error: 'n' undeclared\nlib/x.c:13:1: warning: unused\nlib/y.c:1:2: fatal error: no such file")]
    return traces.diagnostics(spark.createDataFrame(rows, "bug_id string, content string"), ["bug_id"], "content")


def diff_parse(spark, sf_dir):
    return diffs.diff_lines(spark.createDataFrame([("p1", PATCH), ("p2", ""), ("p3", None)], "patch_id string, diff string"), ["patch_id"], "diff")


def patch_intent(spark, sf_dir):
    lines = diff_parse(spark, sf_dir).withColumn("message", F.lit("Fix overflow in size computation"))
    out = scoring.patch_intent(lines, ["patch_id"], "message")
    return out.select(*(F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def _flat(df: DataFrame) -> DataFrame:
    """Lists as one text each."""
    return df.select(*(F.array_join(c, ">").alias(c) if kind == "array<string>" else F.col(c) for c, kind in df.dtypes))


def lex_facts(spark, sf_dir):
    return _flat(lexer.facts(spark.createDataFrame([("r", "lib/store.c", SOURCE)], "repo_id string, path string, content string")))


def template_normalise(spark, sf_dir):
    rows = [("12: memcpy(dst, src, total_len + 4);",), ('call(name, other, name, "text", NULL);',)]
    return spark.createDataFrame(rows, "snippet string").select("snippet", text.template(F.col("snippet")).alias("template"))


def reference_urls(spark, sf_dir):
    rows = ["ttps://github.com/a/b/commit/ABCDEF1234567", "https://gitlab.com/g/s/p/-/merge_requests/7", "www.example.org/x/y.git", "https://github.com/a/b/compare/v1...deadbeef01", "ftp://h/p", "https://github.com/a/b/issues/3"]
    url = urls.repaired(F.col("url"))
    return spark.createDataFrame([(r,) for r in rows], "url string").select("url", url.alias("repaired")).select("url", urls.parsed(F.col("repaired")).alias("r")).select("url", "r.*")


def graph_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three small slices: two of a size that flows into a copy, one of a pointer that is freed and used."""
    n = lambda bug, i, line, func, s, kinds, ents, defs, used, calls=(), mem=(), trig=False: (bug, i, "lib/store.c", line, func, s, list(kinds), list(ents), list(defs), list(used), list(calls), list(mem), trig)
    nodes = []
    for bug in ("n", "m"):
        nodes += [
            n(bug, f"{bug}1", 5, "room_for", "int total = count * width;", ["assignment", "declaration"], ["total"], ["total"], ["count", "width"]),
            n(bug, f"{bug}2", 12, "run", "char *buf = grow(p, total);", ["assignment", "function_call"], ["total", "buf"], ["buf"], ["p", "total"], ["grow"]),
            n(bug, f"{bug}3", 22, "run", "memcpy(buf, input, len);", ["function_call", "memory_operation"], ["buf"], [], ["buf", "input", "len"], ["memcpy"], ["copy"], True),
        ]
    nodes += [n("u", "u1", 3, "drop", "free(obj);", ["function_call", "memory_operation"], ["obj"], [], ["obj"], ["free"], ["deallocation"]), n("u", "u2", 9, "use", "obj->x = 1;", ["assignment"], ["obj"], ["x"], ["obj"], trig=True)]
    edges = [(b, f"{b}1", f"{b}2", "data_dependence", "total", True) for b in "nm"] + [(b, f"{b}2", f"{b}3", "call_argument", "buf", True) for b in "nm"] + [("u", "u1", "u2", "deallocation_site", "obj", True)]
    reports = [("n", "buffer_overflow", "store"), ("m", None, "store"), ("u", "use_after_free", "other")]
    return spark.createDataFrame(nodes, plan.NODES), spark.createDataFrame(edges, plan.EDGES), spark.createDataFrame(reports, plan.REPORTS)


def library(spark: SparkSession) -> DataFrame:
    rows = [(1, "incorrect_size_computation", "length_calculation", 500, 0.92, ["int <size_var> = <size_var> * <int>;"]), (2, "ownership_or_lifetime_operation", "lifetime_management", 40, 0.8, ["<free_op>(<var1>);"])]
    return spark.createDataFrame(rows, "pattern_id int, category string, operation_type string, support_count long, confidence double, templates array<string>")


def root_cause_ranking(spark, sf_dir):
    nodes, edges, reports = graph_tables(spark)
    frames = spark.createDataFrame([("n", "lib/store.c", 22, "run")], plan.FRAMES)
    priors = spark.createDataFrame([("store", "incorrect_size_computation", 0.8)], "project string, key string, share double")
    out = plan.candidates(nodes, edges, reports, frames, library(spark), priors)
    return out.select("bug_id", "rank", "node_id", "line", "label", F.round("score", 4).alias("score"), "matched_bug_pattern", "cve_pattern_prior_score")


def causal_chains(spark, sf_dir):
    nodes, edges, reports = graph_tables(spark)
    return _flat(plan.chains(plan.candidates(nodes, edges, reports), nodes, edges))


def stream_resume(spark, sf_dir):
    return resume.replay(spark, f"{sf_dir}/events.parquet")


QUERIES = {f.__name__: f for f in (frame_parse, sanitizer_parse, diagnostics_parse, diff_parse, patch_intent, lex_facts, template_normalise, reference_urls, root_cause_ranking, causal_chains, stream_resume)}
