import hashlib
import random
import re

import pytest

from causeway.llm import decontaminate as D


def words(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(size, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= x
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def data():
    r = random.Random(1)
    vocab = ["A", "the", "Ärz", "É", "x1", "don't", "B-c", "日本", "and", "of"]
    item = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, item(r.choice([1, 2, 3, 5, 9, 10, 11, 30]) + 3)) for i in range(2, 14)] + [(None, "the the"), (3, ""), (4, None), (5, "q w")]
    docs = []
    for i in range(60):
        t = item(r.randint(0, 40))
        if r.random() < 0.5:
            p = r.choice(items)[1] or ""
            t = t + "; " + p.upper().replace("É", "É") + "! " + item(4)
        docs.append((i, t))
    return docs + [(None, docs[3][1]), (7, docs[7][1]), (8, None), (9, ""), (10, "q W " * 3000)], items


@pytest.mark.parametrize("max_set", [0, 50_000])
def test_equals_brute_force(spark, max_set):
    docs, items = data()
    d = spark.createDataFrame([(i, t, 0, "w") for i, t in docs], "doc_id long, text string, key int, item string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, h int")
    got = sorted(map(str, (tuple(r) for r in D.digest(d, b, max_set=max_set).collect())))
    assert got == sorted(map(str, brute(docs, items)))


def test_clean(spark):
    docs, items = [(1, "Keep this. One two three four!! And more."), (2, "clean text"), (3, None), (4, "ONE two, Three four")], [(1, "one two three four")]
    d = spark.createDataFrame([(i, t, "k", "x", "y") for i, t in docs], "doc_id long, text string, key string, _key string, _row string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.doc_id for r in D.clean(d, b).collect()) == [2, 3]
    out = D.clean(d, b, mode="spans")
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "Keep this!! And more."), (2, "clean text"), (3, ""), (4, "")]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.digest(d, b).collect()] == [False]
    assert D.digest(d.limit(0), b).count() == 0
    assert D.clean(d, b).count() == 1 and D.clean(d, b, mode="spans").count() == 1
