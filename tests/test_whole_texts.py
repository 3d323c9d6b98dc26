"""Queries that read whole texts, on words planted far into them."""

from causeway import queries


def tables(spark, path, **named):
    for name, (rows, schema) in named.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_token_overlap_whole(spark, tmp_path):
    far = "filler " * 200
    docs = [(1, "alpha other", "en", "s", 11), (2, far + "alpha beta gamma", "en", "s", 1416), (3, "alpha beta gamma delta", "en", "s", None)]
    d = tables(spark, tmp_path, documents=(docs, DOCS), benchmark=([(7, "Alpha beta gamma"), (8, "alpha delta")], "item_id long, text string"))
    got = {r.item_id: (r.doc_id, r.score) for r in queries.QUERIES["token_overlap"](spark, d).collect()}
    assert got == {7: (2, 1.0), 8: (3, 1.0)}


def test_slice_reach_whole(spark, tmp_path):
    far = "a " * 40
    turns = [(1, i, "user", f"{far}name{i} name{i + 1}") for i in range(37)]  # a chain of more than 32 links, none before character 60
    d = tables(spark, tmp_path, conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert {r.stmt for r in queries.QUERIES["slice_reach"](spark, d).collect()} == set(range(37))


def test_templates_of_whole_texts(spark, tmp_path):
    far = "x " * 150
    d = tables(spark, tmp_path, documents=([(1, far + '12 "s" é3 b4', "en", "s", 1), (2, "none", "en", "s", 4), (3, None, "en", "s", None)], DOCS))
    got = {r.doc_id: r.template for r in queries.QUERIES["literal_template"](spark, d).collect()}
    assert got == {1: far + "<int> <str> é<int> b4"}
    got = {r.doc_id: r.template for r in queries.QUERIES["template_normalise_documents"](spark, d).collect()}
    assert got[1].startswith("<var1> <var1>") and "<int> <str>" in got[1] and got[2] == "<var1>" and got[3] is None


def test_rules_on_whole_texts(spark, tmp_path):
    far = "word " * 20
    docs = [(4, "plain " + far, "en", "s", 1), (15, far + "buffer", "en", "s", 1), (10, far + "use after free", "en", "s", 1), (21, "item 1 of a", "en", "s", 1), (32, "item 25 of a", "en", "s", 1)]
    d = tables(spark, tmp_path, documents=(docs, DOCS))
    got = {r.doc_id: r for r in queries.QUERIES["severity_text_rules"](spark, d).collect()}
    assert got[4].pattern == "integer_overflow" and got[15].pattern == "integer_overflow_to_memory_error"
    assert got[10].bug_class == "use_after_free"
    top = queries.QUERIES["top_templates_per_cluster"](spark, d).where("rank = 1").first()
    assert (top.template, top.n) == ("item <int> of a", 2)
