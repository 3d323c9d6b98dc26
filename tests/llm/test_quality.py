import numpy as np
from pyspark.sql import functions as F

from causeway.llm import quality as Q


def corpus(n=600):
    """Good texts, shouting ones (low quality) and ones with an insult (toxic), rated as in the labels table."""
    r = np.random.default_rng(4)
    vocab = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    docs, labels = [], []
    for i in range(n):
        words = list(r.choice(vocab, r.integers(20, 120)))
        kind = int(r.integers(0, 3))
        if kind == 0:
            words[int(r.integers(0, len(words)))] = str(r.choice(["zounds", "zoundsen"]))
        text = " ".join(words)
        docs.append((i, text.upper() + "!!! " * 20 if kind == 1 else text, "x", 0))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0, "y"))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, keep string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels[:400])
    model = Q.train(d, lab)
    assert (np.diff(model[1]) > 0).all()
    got = {r.doc_id: r for r in Q.score(d, model).collect()}
    held = [(got[i], q, t) for i, q, t, _ in labels[400:]]
    right = sum(r.keep == (q == 1 and t == 0) for r, q, t in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.tail_prob <= 1 and r.tail_prob <= r.expected_grade <= 2 for r, _, _ in held)
    mean = lambda k: np.mean([r.expected_grade for r, q, t in held if (0 if t else 1 if not q else 2) == k])
    assert mean(0) < mean(1) < mean(2)
    kept = Q.select(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_row_order_and_partitions_change_nothing(spark):
    docs, labels = corpus(200)
    d, lab = frames(spark, docs, labels)
    one = Q.score(d, Q.train(d, lab)).orderBy("doc_id").collect()
    two = Q.score(d.repartition(7), Q.train(d.orderBy(F.desc("doc_id")).repartition(5), lab.repartition(3))).orderBy("doc_id").collect()
    assert one == two


def test_gradient():
    """The fit beats any small change of its thresholds on an unpenalised likelihood of thresholds alone."""
    grades = np.array([0] * 20 + [1] * 30 + [2] * 50)
    _, theta = Q.fit([np.array([1], np.int32)] * 100, grades, steps=2000)
    p = Q.tails(np.zeros(1) + 0, theta)[0]
    w, _ = Q.fit([np.array([1], np.int32)] * 100, grades, steps=2000)
    p = Q.tails(np.array([w[1]]), theta)[0]
    assert abs(p[0] - 0.8) < 0.02 and abs(p[1] - 0.5) < 0.02


def test_edges(spark):
    docs = [(1, None, "a", 1), (2, "", "a", 1), (None, "word", "a", 1), (3, "word " * 100_000, "a", 1), (3, "again", "a", 1)]
    d, lab = frames(spark, docs, [(3, 1, None, "t"), (None, 1, 1, "t"), (9, None, None, "t"), (3, 0, 0, "t")])
    model = Q.train(d, lab)
    assert Q.score(d, model).count() == 5
    empty = Q.train(d, lab.limit(0))
    rows = Q.score(d, empty).collect()
    assert len({r.tail_prob for r in rows}) == 1
    assert Q.score(d.limit(0), model).count() == 0 and Q.select(d.limit(0), lab).count() == 0


def plain_likelihood(w, theta, rows, grades):
    """The penalised log likelihood, row by row, from P(grade = k) = P(grade > k - 1) - P(grade > k)."""
    total = -Q.L2 / 2 * float((w * w).sum())
    for r, g in zip(rows, grades, strict=True):
        x = sum(w[c] for c in r)
        above = [1.0, *(1 / (1 + np.exp(t - x)) for t in theta), 0.0]
        total += float(np.log(above[g] - above[g + 1]))
    return total


def test_fit_is_a_maximum_of_the_plain_likelihood():
    r = np.random.default_rng(2)
    rows = [np.array(sorted(r.choice(30, r.integers(1, 8), replace=False)), np.int32) for _ in range(400)]
    grades = np.array([min(2, max(0, int(len(x) / 3 + (3 in x) - (5 in x) + r.normal() / 2))) for x in rows])
    w, theta = Q.fit(rows, grades, steps=1500)
    best = plain_likelihood(w, theta, rows, grades)
    for i in range(30):
        for step in (-0.02, 0.02):
            v = w.copy()
            v[i] += step
            assert plain_likelihood(v, theta, rows, grades) < best + 1e-3
    for i in range(2):
        for step in (-0.02, 0.02):
            t = theta.copy()
            t[i] += step
            assert plain_likelihood(w, t, rows, grades) < best + 1e-3


def test_scores_equal_plain_sums(spark):
    docs, labels = corpus(150)
    d, lab = frames(spark, docs, labels)
    w, theta = Q.train(d, lab)
    for r in Q.score(d, (w, theta)).collect():
        x = sum(float(np.float32(w[Q.bucket(t)])) for t in Q.tokens(docs[r.doc_id][1]))
        tail = [1 / (1 + np.exp(t - x)) for t in theta]
        assert abs(r.tail_prob - tail[1]) < 1e-9 and abs(r.expected_grade - sum(tail)) < 1e-9
        assert r.keep == (r.tail_prob >= Q.CUT)
