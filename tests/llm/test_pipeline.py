import re

import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline as P
from causeway.llm import quality, spm
from causeway.llm.common import read

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_equal_brute_force(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    given = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.keep}
    assert 0 < len(kept) < len(given)
    sets = {i: shingles(given[i].text) for i in kept}
    like = {i: [j for j in kept if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in kept}
    least = {i: i for i in kept}
    for _ in range(12):  # more rounds than any group here is long
        least = {i: min(least[j] for j in like[i]) for i in kept}
    one = {i for i in kept if least[i] == i}
    items = [grams(r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = {i for i in one if not any(grams(given[i].text) & g or any(len(x) < 10 and x == tuple(words(given[i].text)[k : k + len(x)]) for x in g for k in range(len(words(given[i].text)))) for g in items)}
    rows = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(rows) == clean
    ref = sentencepiece.SentencePieceProcessor(model_file=spm.default_path())
    for i, r in rows.items():
        text = ref.decode(list(r.ids))
        assert "@mail" not in text
        if not re.search("[0-9@]", given[i].text):
            assert list(r.ids) == ref.encode(given[i].text)
        assert r.parity and r.round_trip


def test_stages_return_the_columns_of_documents(spark):
    docs = read(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found
    for n in range(1, 11):
        assert sum(bool(re.match(f"op{n}_", q)) for q in found) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(found)


@pytest.mark.parametrize("query", [q for q in __spark_entry__.oracle_sql() if re.match(r"op\d+_", q)])
def test_sql_gives_the_same(spark, query):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.execute(__spark_entry__.oracle_sql()[query]).fetchall()
    names = [d[0] for d in c.description]
    got = __spark_entry__.queries()[query](spark, SF)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(names).collect())
