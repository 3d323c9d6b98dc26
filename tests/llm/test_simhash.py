import random

import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import simhash as S
from causeway.llm.common import Scratch


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint) -> component of each row."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "Éa É B c\x0bd", "x " * 200_000, "  a b c d e"])
def test_fingerprint(text):
    assert S.simhash(text) & (1 << 64) - 1 == plain(text)


def test_matches_native_hash(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert S.simhash("A b\nC") == h


def test_components_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(12):
        t = [r.choice(words) for _ in range(r.choice([1, 2, 3, 20, 300]))]
        for _ in range(r.randint(1, 6)):
            u = t[:]
            u[r.randrange(len(u))] = r.choice(words)
            texts.append(" ".join(u))
    texts += ["", None, "Same TEXT here now", "same text\there now", "same text here now"]
    rows = [(100 - i, t, "x", i) for i, t in enumerate(texts)] + [(None, "same text here now", "x", 1), (7, "same text here now", "x", 1), (7, "same text here now", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = S.near_duplicates(df).collect()
    want = brute([(d, plain(t)) for d, t, *_ in rows])
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in got) == sorted((str(d), f"{plain(t):016x}", c) for (d, t, *_), c in zip(rows, want, strict=True))
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({c for c in want if c is not None})


@pytest.mark.parametrize("crowd", [2, 4096])
def test_links_keep_all_components(spark, crowd):
    r = random.Random(6)
    prints = set()
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(40):
            y = x
            for b in r.sample(range(64), r.randint(0, 4)):
                y ^= 1 << b
            prints.add(y)
            if r.random() < 0.3:
                x = y
    rows = [(p - (1 << 64) if p >> 63 else p, p) for p in prints]
    scratch = Scratch(spark, "t")
    links = S.links(spark.createDataFrame([(a,) for a, _ in rows], "fp long"), scratch, crowd)
    found = {r.node: r.component for r in S.components(links, scratch).collect()}
    want = brute(rows)
    assert [found.get(a, a) for a, _ in rows] == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0
    assert S.keep_first(df).count() == 0


def test_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(edges, Scratch(spark, "t")).collect()
    assert len(got) == n and {x.component for x in got} == {0}
