from pyspark.sql import Row
from pyspark.sql import functions as F

from causeway import fixtures
from causeway.functions import diffs, lexer, text, traces, urls
from causeway.operators import scoring as C
from causeway.sources import readers, sinks


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_frames(spark):
    rows = {(r.bug_id, r["index"], r.format): r for r in fixtures.frame_parse(spark, "").collect()}
    assert len(rows) == 6
    a = rows["b1", 0, "sanitizer"]
    assert (a.function, a.file, a.line, a.column) == ("put_bytes", "/work/lib/store.c", 41, 9)
    assert rows["b1", 1, "module"].module == "/work/app" and rows["b1", 1, "module"].function == "handle"
    assert (rows["b2", 1, "debugger"].file, rows["b2", 1, "debugger"].column) == ("app/main.c", 3)
    assert rows["b2", 2, "parenthesis"].function == "walk"


def test_sanitizer(spark):
    rows = {r.bug_id: r for r in fixtures.sanitizer_parse(spark, "").collect()}
    assert rows["b1"].summary == "AddressSanitizer: heap-buffer-overflow" and rows["b1"].access == "write" and rows["b1"].bug_type == "buffer_overflow"
    assert (rows["b1"].file, rows["b1"].line, rows["b1"].function) == ("/work/lib/store.c", 41, "put_bytes")
    assert rows["b2"].summary is None and rows["b2"].line == 41


def test_diagnostics(spark):
    rows = fixtures.diagnostics_parse(spark, "").collect()
    assert sorted((r.file, r.line, r.message) for r in rows) == [("lib/x.c", 12, "'n' undeclared"), ("lib/y.c", 1, "no such file")]


def test_diff(spark):
    rows = sorted(fixtures.diff_parse(spark, "").collect(), key=lambda r: r.pos)
    assert [(r.kind, r.old_no, r.new_no) for r in rows] == [("context", 38, 38), ("del", 39, None), ("add", None, 39), ("add", None, 40), ("add", None, 41), ("context", 40, 42), ("context", 41, 43)]
    assert {r.file for r in rows} == {"lib/store.c"}
    h = diffs.hunks(fixtures.diff_parse(spark, ""), ["patch_id"]).first()
    assert h.function == "put_bytes" and h.removed == ["int room = n + 1;"] and len(h.added) == 3


def test_patch_intent(spark):
    r = fixtures.patch_intent(spark, "").first()
    assert r.direct_fix == 0.85 and r.intent == "direct_fix"


def test_urls(spark):
    rows = {r.url: r for r in fixtures.reference_urls(spark, "").collect()}
    a = rows["ttps://github.com/a/b/commit/ABCDEF1234567"]
    assert (a.kind, a.provider, a.repo_url, a.commit_sha) == ("commit", "github", "https://github.com/a/b", "abcdef1234567")
    b = rows["https://gitlab.com/g/s/p/-/merge_requests/7"]
    assert (b.kind, b.repo_url, b.pull_request) == ("pull_request", "https://gitlab.com/g/s/p", "7")
    assert rows["https://github.com/a/b/compare/v1...deadbeef01"].commit_sha == "deadbeef01"
    assert rows["www.example.org/x/y.git"].repo_url == "https://www.example.org/x/y"
    assert rows["ftp://h/p"].kind == "other" and rows["https://github.com/a/b/issues/3"].issue_id == "3"
    c = one(spark, urls.cpe(F.col("u")), u="cpe:2.3:a:vend:prod:*:x")
    assert (c.vendor, c.product, c.version) == ("vend", "prod", None)


def test_texts(spark):
    got = [r.template for r in fixtures.template_normalise(spark, "").collect()]
    assert got == ["<copy_op>(<buffer_var>, <buffer_var>, <size_var> + <int>);", "<var1>(<var2>, <var3>, <var2>, <str>, <null>);"]
    assert text.first_json('noise {"a": "}"} {') == '{"a": "}"}' and text.first_json("{{") is None and text.first_json(None) is None
    assert one(spark, text.token(F.col("v")), v="  Heap-Buffer  Overflow! ") == "heap_buffer_overflow"
    assert one(spark, text.head(F.col("v"), 3), v="abcdef") == "abc..."
    assert one(spark, text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), v=1) == 0.5


SOURCE = """#include <stdlib.h>
/* a { comment */
static int compute_size(int count, int width) {
    int total = count * width; // note {
    return total;
}

char *make_buffer(int len)
{
    char *ptr = malloc(len);
    if (ptr != NULL) {
        memset(ptr, 0, len);
    }
    return ptr;
}
struct S { int x; };
void run(struct ctx *c, const char *input) {
    int len = compute_size(c->count, SIZE_MAX_W);
    char *buf = make_buffer(len);
    c->data[len] = "}"[0];
    memcpy(buf, input, len);
    free(buf);
}
"""


def test_lexer(spark):
    files = spark.createDataFrame([("r", "a/x.c", SOURCE), ("r", "b.c", None)], "repo_id string, path string, content string")
    t = lexer.tables(files)
    functions = {r.func: r for r in t["functions"].collect()}
    assert {k: (v.line, v.end_line, v.parameters) for k, v in functions.items()} == {"compute_size": (3, 6, ["count", "width"]), "make_buffer": (8, 15, ["len"]), "run": (17, 23, ["c", "input"])}
    s = {r.line: r for r in t["statements"].collect()}
    assert s[4].statement_types == ["assignment", "declaration"] and s[4].defined == ["total"]
    assert s[10].memory_kinds == ["allocation"] and s[10].memory_targets == ["ptr"]
    assert s[11].condition == "ptr != NULL" and s[12].block_depth == s[11].block_depth + 1
    assert s[20].index_variables[:1] == ["len"] and "c.data" in s[20].field_accesses
    assert s[5].returned == "total" and s[22].memory_kinds == ["deallocation"]
    calls = {(r.callee, r.line): r for r in t["calls"].collect()}
    assert calls["make_buffer", 19].target == functions["make_buffer"].function_id and calls["make_buffer", 19].arguments == ["len"]
    assert calls["malloc", 10].target is None
    assert lexer.without_comments('a /* x\ny */ "//" // z') == 'a     \n     "//"     '
    assert lexer.split_top("a, f(b, c), {d, e}") == ["a", "f(b, c)", "{d, e}"]


def test_advisories(spark):
    cve = '{"cveMetadata":{"cveId":"cve-2020-1"},"containers":{"cna":{"descriptions":[{"lang":"de","value":"x"},{"lang":"en","value":"heap overflow"}],"problemTypes":[{"descriptions":[{"cweId":"CWE-787"}]}],"references":[{"url":"ttps://github.com/a/b/commit/1234567"},{"url":"nope"}]},"adp":[{"references":[{"url":"http://h/1"}]}]}}'
    nvd = '{"vulnerabilities":[{"cve":{"id":"CVE-2020-2","descriptions":[{"lang":"en","value":"uaf"}],"weaknesses":[{"description":[{"value":"CWE-416"}]}],"references":[{"url":"www.x.org"}]}}]}'
    hub = '[{"ghsa_id":"G","cve_id":null,"identifiers":[{"type":"CVE","value":"CVE-2020-3"}],"summary":"s","references":["https://r"],"cwes":[{"cwe_id":"CWE-20"}]},{"ghsa_id":"H"}]'
    own = '{"records":[{"cve_id":"CVE-2020-4","cwes":["CWE-1"],"description":"d","language":"c","project":"p","repo_url":"https://h/o/p","references":[]}]}'
    df = lambda v: spark.createDataFrame([(v,)], "v string")
    rows = {r.cve_id: r for r in readers.records(cve_list=df(cve), nvd=df(nvd), github=df(hub), project=df(own)).collect()}
    assert set(rows) == {"CVE-2020-1", "CVE-2020-2", "CVE-2020-3", "CVE-2020-4"}
    assert rows["CVE-2020-1"].description == "heap overflow" and rows["CVE-2020-1"].references == ["https://github.com/a/b/commit/1234567", "http://h/1"]
    assert rows["CVE-2020-2"].cwes == ["CWE-416"] and rows["CVE-2020-3"].description == "s" and rows["CVE-2020-4"].project == "p"
    c = one(spark, C.advisory_class(F.col("d"), F.col("w")), d="heap overflow of a size", w=["CWE-787"])
    assert (c.bug_class, c.pattern, c.confidence) == ("buffer_overflow", "incorrect_length_or_bounds_calculation", 0.7)


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "repo/src/build").mkdir(parents=True)
    (tmp_path / "repo/src/a.c").write_text("int f(void) { return 1; }")
    (tmp_path / "repo/src/build/b.c").write_text("int g(void) { return 1; }")
    (tmp_path / "repo/src/c.txt").write_text("no")
    got = readers.source_files(spark, f"{tmp_path}/repo", "r").collect()
    assert [(r.path, r.content) for r in got] == [("src/a.c", "int f(void) { return 1; }")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    schema = spark.createDataFrame([(1,)], "a int").schema
    assert sorted(r.a for r in readers.log(spark, f"{tmp_path}/log.jsonl", schema).collect()) == [1, 2]
    (tmp_path / "w.json").write_text('{"entries": [{"a": 5}]}')
    (tmp_path / "l.json").write_text('[{"a": 6}]')
    assert [readers.wrapped_records(spark, f"{tmp_path}/{f}.json", schema).first().a for f in "wl"] == [5, 6]
    df = spark.createDataFrame([(1, ["x", "y"], "<b>|")], "n int, l array<string>, t string")
    sinks.csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().l == "x;y"
    assert "&lt;b&gt;" in sinks.html(df, "T") and "<b>\\|" in sinks.markdown(df)
    sinks.documents(df, f"{tmp_path}/docs")
    assert spark.read.text(f"{tmp_path}/docs").first().value.startswith('{"l":["x","y"],"n":1')


def test_sanitizer_bug_types(spark):
    kinds = {"heap-use-after-free": "use_after_free", "stack-buffer-overflow": "buffer_overflow", "null-deref": "null_dereference", "signed-integer-overflow": "integer_overflow_to_memory_error", "odd": None}
    for k, v in kinds.items():
        assert one(spark, traces.bug_type(F.col("e")), e=k) == v
