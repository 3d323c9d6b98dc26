from pyspark.sql import functions as F

from causeway.functions import lexer
from causeway.plans import evaluation as E
from causeway.plans import mining as M
from causeway.plans import rank as plan
from causeway.plans import slice as S

SOURCE = """#include <string.h>
static int size_of(int count, int width) {
    int total = count * width;
    return total;
}

char *make(int len) {
    char *mem = malloc(len);
    return mem;
}

void run(const char *input, int count) {
    int len = size_of(count, 4);
    char *ptr = make(len);
    if (ptr != NULL) {
        memcpy(ptr, input, len);
    }
}
"""


def test_slice_and_ranking_from_source(spark):
    files = spark.createDataFrame([("r", "lib/x.c", SOURCE)], "repo_id string, path string, content string")
    facts = {k: v.cache() for k, v in lexer.tables(files).items()}
    triggers = spark.createDataFrame([("b", "r", "lib/x.c", 16)], "bug_id string, repo_id string, file string, line int")
    nodes, edges = S.backward(triggers, facts)
    lines = {r.node_id: r.line for r in nodes.collect()}
    assert set(lines.values()) >= {3, 4, 8, 9, 13, 14, 15, 16}
    found = {(lines[r.source], lines[r.target], r.relation) for r in edges.collect()}
    assert (15, 16, "control_dependence") in found
    assert (13, 16, "data_dependence") in found and (14, 16, "data_dependence") in found
    assert (4, 13, "return_value") in found and (9, 14, "return_value") in found
    assert (3, 4, "integer_influence") in found and (8, 9, "allocation_site") in found
    assert [r.line for r in nodes.where("is_trigger").collect()] == [16]
    reports = spark.createDataFrame([("b", "buffer_overflow", "p")], plan.REPORTS)
    ranked = {r["rank"]: r.line for r in plan.candidates(nodes, edges, reports, k=10).collect()}
    assert ranked[1] == 3 and len(ranked) == nodes.count()
    chains = plan.chains(plan.candidates(nodes, edges, reports), nodes, edges).collect()
    assert any([lines[n] for n in r.path] == [3, 4, 13, 16] for r in chains)


def test_patterns(spark):
    rows = [("CVE-1", "Size computation", "12: total = count * 4;", "data_dependence", 0.9), ("CVE-2", "size-computation", "total = count * 8;", "data_dependence", 0.7), ("CVE-3", "use_after_free", "free(p);", "", 0.8)]
    df = spark.createDataFrame(rows, "cve_id string, pattern string, code_snippet string, signature string, confidence double")
    two = M.patterns(df).collect()
    assert len(two) == 1 and two[0].support_count == 2 and two[0].operation_type == "length_calculation" and two[0].examples == ["CVE-1", "CVE-2"]
    assert two[0].templates == ["<var1> = <size_var> * <int>;"]
    assert M.patterns(df, 1).count() == 2


def test_records(spark):
    refs = spark.createDataFrame([("CVE-1", 0, "https://github.com/a/b/issues/1"), ("CVE-1", 1, "https://github.com/a/c/commit/1234567"), ("CVE-1", 2, "https://github.com/a/c/commit/1234567/")], "cve_id string, pos int, url string")
    assert [tuple(r) for r in M.fix_commits(refs).collect()] == [("CVE-1", "1234567", "https://github.com/a/c/commit/1234567")]
    assert M.repository(refs).first().repo_url == "https://github.com/a/c"
    recs = spark.createDataFrame([("CVE-1", 1, "short", "unknown", None, ["CWE-1"], ["u1"]), ("CVE-1", 2, "longer text", "c", "p", ["CWE-2", "CWE-1"], ["u2", "u1"])], "cve_id string, seq int, description string, language string, project string, cwes array<string>, references array<string>")
    m = M.merged(recs).first()
    assert (m.description, m.language, m.project, m.cwes, m.references) == ("longer text", "c", "p", ["CWE-1", "CWE-2"], ["u1", "u2"])
    cases = spark.createDataFrame([("P", "x", "o", "b"), ("p", "x", "o2", None), ("q", "x", "o", "b")], "project string, pattern string, operation string, bug_type string")
    got = {(r.project, r.kind, r.key): r.share for r in M.project_priors(cases).collect()}
    assert got == {("p", "pattern", "x"): 1.0, ("p", "operation", "o"): 0.5, ("p", "operation", "o2"): 0.5, ("p", "bug_type", "b"): 1.0}
    rules = M.feature_rules(spark.createDataFrame([("k", True, 1), ("k", True, 2), ("k", False, 3)], "g string, a boolean, b int"), ["g"], ["a", "b"])
    assert [(r.feature, r.value, r.share) for r in rules.collect()] == [("a", "true", 0.6667)]


def test_evaluation(spark):
    rows = [("1", 1, 100, 5.0), ("1", 2, 100, 5.0), ("1", 3, 20, 9.0), ("2", 1, 0, None)]
    best = E.best_records(spark.createDataFrame(rows, "local_id string, seq int, quality int, elapsed_seconds double")).collect()
    assert sorted((r.local_id, r.seq) for r in best) == [("1", 2), ("2", 1)]
    logs = spark.createDataFrame([("a", "completed", "generated_preferred", 0.95, None, None, None, "x"), ("b", "completed", "generated_preferred", 0.95, True, None, None, None), ("c", "completed", "generated_preferred", 0.95, False, False, None, "x")], "local_id string, status string, claim string, confidence double, is_pseudo_patch boolean, cuts_root boolean, safe boolean, verdict string")
    assert [r.local_id for r in E.strict(logs).collect()] == ["a"]
    assert {r.verdict: r.n for r in E.verdicts(logs).collect()} == {"x": 2, "None": 1}
    edges = spark.createDataFrame([(v,) for v in (0.7, 0.85, 0.99, 1.0, 0.1, None)], "confidence double").select(F.lit("d").alias("dataset"), "confidence", F.lit("v").alias("verdict"))
    assert {r.bin: r.n for r in E.bins(edges).collect()} == {">=0.70": 1, ">=0.85": 1, ">=0.99": 2, "<0.70": 1, "missing": 1}
    seen = spark.createDataFrame([(True, True, True, True), (True, True, None, True), (False, None, None, None), (True, False, None, None)], "b boolean, c boolean, g boolean, r boolean")
    assert [r.v for r in seen.select(E.dynamic_verdict(F.col("b"), F.col("c"), F.col("g"), F.col("r")).alias("v")).collect()] == ["both_fix", "reference_fixes_generated_unknown", "base_build_failed", "base_not_triggered"]
