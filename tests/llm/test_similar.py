import random

import pytest

import corpus_pipeline
from causeway.llm import simhash as S


def plain(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [plain(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def made(r, groups, copies, length, changes):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        t = [r.choice(words) for _ in range(length)]
        for _ in range(copies):
            u = t[:]
            for _ in range(r.randint(0, changes)):
                u[r.randrange(len(u))] = r.choice(words)
            texts.append(" ".join(u))
    return texts


def test_stage_finds_more_than_three_bits(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    t = [r.choice(words) for _ in range(250)]
    u = t[:40] + ["new"] + t[41:130] + ["other"] + t[131:]
    texts = [" ".join(t), " ".join(u)]
    assert (S.simhash(texts[0]) ^ S.simhash(texts[1])).bit_count() > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.dedupe(spark, df, "").collect()] == [0]


@pytest.mark.parametrize("crowd", [1, 64])
def test_equal_to_brute_force(spark, crowd):
    r = random.Random(8)
    texts = made(r, 6, 12, 120, 6) + made(r, 1, 60, 40, 2) + ["", None, " ", "one", "One", "a b c d e", "a b c d e f"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.keep_first(df, similarity=(4, 5), many=crowd).collect()
    assert sorted(x.doc_id for x in got) == brute(rows)
    assert len(got) < len(rows)
