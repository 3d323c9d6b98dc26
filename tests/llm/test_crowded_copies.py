"""A large group of copies, each changed in places of its own, has few links: its pairs aren't all compared."""

import random

import pytest

from causeway.llm import simhash as S
from causeway.llm.common import Scratch


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def family(changes, copies, seed=5):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    out = []
    for c in range(copies):
        words = list(base)
        for at in r.sample(range(2, 398, 5), changes):
            words[at] = f"own{c}x{at}"
        out.append(" ".join(words))
    # some have a near copy of their own, which is a link
    return out + [f"{t} once more" for t in out[: copies // 10]]


@pytest.mark.parametrize("changes", [2, 10])
def test_few_pairs_and_no_link_lost(spark, monkeypatch, changes):
    texts = family(changes, 200)
    seen, write = [], Scratch.write

    def watched(self, df):
        out = write(self, df)
        if df.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in S.keep_first(df, similarity=(4, 5), many=16).collect()}
    sets = [shingles(t) for t in texts]
    least = list(range(len(texts)))
    like = [[j for j in least if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in least]
    for _ in range(5):
        least = [min(least[j] for j in like[i]) for i in range(len(texts))]
    assert got == {i for i, x in enumerate(least) if i == x}
    assert max(seen) < 10 * len(texts)


@pytest.mark.parametrize("changes", [6, 8])
def test_hardly_more_pairs_than_links(spark, monkeypatch, changes):
    """Changed so little that each could have a link, but no two of them do."""
    test_few_pairs_and_no_link_lost(spark, monkeypatch, changes)


def test_parities_never_exceed_the_difference():
    r = random.Random(3)
    for n in (0, 1, 30, 400, 5000):
        a, b = (S._set(" ".join(f"v{r.randrange(90)}" for _ in range(n)), 2) for _ in "ab")
        bits = sum(int(x).bit_count() for x in (S._odd(a) ^ S._odd(b)).view("uint64"))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))
