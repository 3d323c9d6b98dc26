"""Steps whose memory in one task must not grow with what a key has."""

import math

import duckdb

from causeway import queries
from causeway.functions import text
from causeway.operators import joins
from causeway.plans import rank


def test_theta_ranks_one_row_a_part(spark, tmp_path, monkeypatch):
    rows = [(10 * (7 * i + j) + k, f"B{i}" if i < 5 else None, f"T{j}" if j < 6 else None, (3 * i + 5 * j + k) % 50) for i in range(6) for j in range(7) for k in range(2 + (i * j) % 4)]
    rows += [(r[0], "B1", "T3", 9) for r in rows[::9]] + [(9000, "none", "T2", 1), (9001, "none", "none", 1), (9002, "B3", None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    ranked, best = [], joins.keep_best
    monkeypatch.setattr(joins, "keep_best", lambda df, *a: ranked.append(df.count()) or best(df, *a))
    got = sorted(map(tuple, queries.QUERIES["theta_best_match"](spark, str(tmp_path)).select("p_partkey", "pattern_id", "score").collect()))
    db = duckdb.connect()
    db.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == sorted(db.execute(queries.ORACLE_SQL["theta_best_match"]).fetchall())
    assert max(ranked) <= len(rows)


def test_token_overlap_ranks_counts(spark, tmp_path, monkeypatch):
    words = [f"word{i}" for i in range(12)]
    docs = [(i, " ".join(words[j] for j in range(12) if (i * 7 + j * j) % (2 + i % 5) == 0)) for i in range(60)] + [(None, " ".join(words)), (99, None), (98, " ".join(words[:6]))]
    items = [(1, " ".join(words[:6])), (2, "Word7 word8 word9 word9 of"), (3, "word11 unseen"), (4, "nothing of these")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranked, best = [], queries.R.keep_best
    monkeypatch.setattr(queries.R, "keep_best", lambda df, *a: ranked.append(df.count()) or best(df, *a))
    got = sorted(map(tuple, queries.QUERIES["token_overlap"](spark, str(tmp_path)).select("item_id", "doc_id", "score").collect()))
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(db.execute(queries.ORACLE_SQL["token_overlap"]).fetchall())
    assert max(ranked) <= 6 + 3 + 2


def test_whole_texts_go_to_python_in_small_batches(spark, tmp_path):
    spark.createDataFrame([(i, f"call(name{i}, len, {i}) name{i} other" if i % 9 else None) for i in range(250)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.QUERIES["template_normalise_documents"](spark, str(tmp_path))
    got = {r.doc_id: r.template for r in df.collect()}
    assert len(got) == 250 and all(v == ("<var1>(<var2>, <size_var>, <int>) <var2> <var3>" if i % 9 else None) for i, v in got.items())
    frames = [df, *(spark.createDataFrame([("x",)], "text string").select(f("text")) for f in (text.json_object, text.unfixed))]
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in frames]
    assert all("BatchEvalPython" in p and "Arrow" not in p for p in plans)  # Arrow batches have 10,000 rows


def test_pattern_prior_ranks_one_row_a_node(spark, monkeypatch):
    nodes = [("b", str(i), f"p{i % 3}", f"o{i % 4}" if i % 5 else None, "len_word1" if i % 2 else "other", 0.1) for i in range(40)]
    lib = [(i, f" P{i % 3}" if i % 7 else None, f"o{i % 5}", 7 * i % 20, 0.5, [f"word{i % 2} len"]) for i in range(60)]
    ranked, best = [], joins.keep_best
    monkeypatch.setattr(joins, "keep_best", lambda df, *a: ranked.append(df.count()) or best(df, *a))
    df = spark.createDataFrame(nodes, "bug_id string, node_id string, matched_bug_pattern string, operation string, low string, bug_pattern_score double")
    library = spark.createDataFrame(lib, "pattern_id int, category string, operation_type string, support_count long, confidence double, templates array<string>")
    got = {r.node_id: (r.cve_pattern_prior_score, r.cve_pattern_id) for r in rank.with_pattern_prior(df, library).collect()}

    def prior(node, entry):
        words = {w for w in node[4].split("_") if len(w) > 2}
        named = set(entry[5][0].split())
        lent = 0.45 * ((entry[1] or "").strip().lower() == node[2]) + 0.25 * (entry[2] == node[3])
        return lent and min(lent + 0.18 * math.log1p(entry[3]) / math.log1p(19) + 0.05 + 0.02 * len(words & named) / len(named), 1)

    for node in nodes:
        score, first = min((-round(prior(node, e), 4), e[0]) for e in lib if prior(node, e))
        assert got[node[1]] == (-score, first)
    assert max(ranked) == len(nodes)
