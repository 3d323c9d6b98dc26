import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm import katz as K


def tokens(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w] + [END]


END, START = ("end",), ("start",)


class Plain:
    """Katz backoff with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.count = [Counter() for _ in range(order + 1)]
        self.follow = [defaultdict(set) for _ in range(order + 1)]
        for t in texts:
            w = [START] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    g = tuple(w[i - k + 1 : i + 1])
                    self.count[k][g] += 1
                    self.follow[k][g[:-1]].add(g[-1])
        self.d = [None] + [K.discounts([sum(1 for v in c.values() if v == r) for r in range(1, K.GT + 2)]) for c in self.count[1:]]

    def mass(self, k, r):
        return (self.d[k][r] if r <= K.GT else 1) * r

    def context(self, k, c):
        seen = self.follow[k].get(c, ())
        n = sum(self.count[k][(*c, w)] for w in seen)
        m = sum(self.mass(k, self.count[k][(*c, w)]) for w in seen)
        return seen, (n + 1 if n and m >= n * (1 - 1e-12) else n), m

    def p(self, w, c=()):
        k = len(c) + 1
        seen, n, m = self.context(k, c)
        r = self.count[k][(*c, w)]
        if r:
            return self.mass(k, r) / n
        if k == 1:
            return 1 - m / n if n else 1.0
        if not n:
            return self.p(w, c[1:])
        return (1 - m / n) / (1 - sum(self.p(x, c[1:]) for x in seen)) * self.p(w, c[1:])

    def score(self, text):
        w = [START] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(w[i], tuple(w[i - self.order + 1 : i]))) for i in range(self.order - 1, len(w)))


def rows():
    r = random.Random(9)
    vocab = ["the", "The", "of", "É", "é", "a\x0bb", "<s>", "</s>", *(f"w{i}" for i in range(40))]
    out = [(i, " ".join(r.choice(vocab[: 3 + int(r.random() ** 3 * 45)]) for _ in range(r.randint(0, 25)))) for i in range(150)]
    out += [(900, None), (901, ""), (902, "always same pair " * 40), (903, "only here unseen xyzzy"), (None, "no id the of"), (5, out[5][1]), (5, out[5][1])]
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("order, block, part", [(2, 1 << 22, 1 << 21), (2, 50, 200), (3, 70, 100), (1, 60, 100)])
def test_equals_plain_katz(spark, order, block, part):
    data = rows()
    model = Plain([t for i, t in data if not held(i)], order)
    c1 = model.count[1]
    n, v = sum(c1.values()), len(c1)
    want = []
    for i, t in data:
        w = tokens(t)
        base = sum(math.log10((c1[(x,)] + 1) / (n + v + 1)) for x in w)
        want.append((i, held(i), len(w), sum(c1[(x,)] > 0 for x in w), n, base, model.score(t)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, id string, block int")
    got = K.score(df.repartition(3), order=order, block_tokens=block, part_tokens=part).collect()
    key = lambda x: (str(x[0]), *x[1:5], round(x[5], 6), round(x[6], 6))
    assert sorted(map(key, got)) == sorted(map(key, want))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_of_a_context_add_up(order):
    data = [t for _, t in rows()]
    model = Plain(data, order)
    vocab = [g[0] for g in model.count[1]] + ["never seen"]
    contexts = list(model.follow[order])[:40] + [("never", "seen")[: order - 1]]
    for c in contexts:
        assert abs(sum(model.p(w, c) for w in vocab) - 1) < 1e-9


def test_discounts():
    d = K.discounts([1000, 400, 220, 140, 100, 75])
    assert d[0] == 1 and ((d[1:] > 0) & (d[1:] < 1)).all() and (np.diff(d[1:]) > 0).all()
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9]):
        d = K.discounts(odd)
        assert ((d > 0) & (d <= 1)).all()


def test_held_out_text_like_the_training_text_scores_higher(spark):
    r = random.Random(3)
    chain = {w: [f"w{r.randrange(30)}" for _ in range(3)] for w in (f"w{i}" for i in range(30))}

    def walk(n):
        w = ["w0"]
        for _ in range(n):
            w.append(r.choice(chain[w[-1]]))
        return " ".join(w)

    data = [(i, walk(60)) for i in range(200)] + [(1000 + i, " ".join(f"w{r.randrange(30)}" for _ in range(61))) for i in range(200)]
    got = {x.doc_id: x for x in K.score(spark.createDataFrame([d for d in data if d[0] < 1000 or held(d[0])], "doc_id long, text string")).collect()}
    like = [x.score / x.n_tokens for i, x in got.items() if i < 1000 and x.held_out]
    unlike = [x.score / x.n_tokens for i, x in got.items() if i >= 1000]
    assert np.mean(like) > np.mean(unlike) + 0.3
    base = [x.base_score / x.n_tokens for i, x in got.items() if i < 1000 and x.held_out]
    assert np.mean(like) > np.mean(base)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert K.score(none).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = K.score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
