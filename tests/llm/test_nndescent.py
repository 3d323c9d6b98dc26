import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import nndescent as N
from causeway.llm.common import Scratch


def brute(rows):
    def ok(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v, lab) else None for _, v, lab in rows]
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    seen, comp = {}, [None] * n
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], [i]
        seen[i] = 1
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen[j] = 1
                    todo.append(j)
                    group.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            comp[j] = min(ids) if ids else None
    return [(rows[i][0], len(link[i]), comp[i], rows[i][0] is not None and rows[i][0] == comp[i]) for i in range(n)]


def table():
    r = np.random.default_rng(11)
    rows = []
    for size in (1, 1, 2, 2, 3, 5, 30, 90):
        for label in (0, 1, 2):
            c = r.standard_normal(16)
            c /= np.linalg.norm(c)
            for _ in range(size):
                x = c + r.standard_normal(16) * r.choice([0.0, 0.02, 0.05, 0.1])
                rows.append((int(r.integers(0, 10**6)), [float(np.float32(v)) for v in x], label))
    rows += [(5, [float(v) for v in r.standard_normal(16)], i % 3) for i in range(200)]
    v = rows[40][1]
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [1.0, None] * 8, 0), (6, [float("inf")] * 16, 1), (7, [], 1), (8, v, None), (None, v, rows[40][2]), (rows[40][0], v, rows[40][2]), (9, v[:8], rows[40][2]), (10, [2 * x for x in v], rows[40][2])]
    return rows


@pytest.mark.parametrize("block", [20, 512])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N.enlarge, "__defaults__", (block,))
    rows = table()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, kind int")
    out = N.near_duplicates(df).collect()
    assert {r.recall for r in out} == {1.0}
    got = sorted(str(tuple(r)[:4]) for r in out)
    assert got == sorted(map(str, brute(rows)))


def test_descent_completes_lists(spark):
    """From a chain of neighbours the lists come to hold the nearest ones."""
    r = np.random.default_rng(1)
    c = r.standard_normal(32)
    vecs = [c + 0.15 * r.standard_normal(32) for _ in range(40)]
    nodes = spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(vecs)], "node long, kind long, vec array<double>")
    chain = spark.createDataFrame([(i, i + 1, 0.95) for i in range(39)], "u long, v long, sim double")
    out = N.descend(chain, nodes, Scratch(spark, "t"))
    assert out.count() > 300


def test_audit_sees_what_is_missing(spark):
    vecs = [[1.0, 0.0, float(i) / 1000] for i in range(10)]
    nodes = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vecs)], "node long, kind int, vec array<double>").withColumn("kind", F.col("kind").cast("string"))
    whole = spark.createDataFrame([(i, 0) for i in range(10)], "node long, component long")
    half = spark.createDataFrame([(i, i // 5) for i in range(10)], "node long, component long")
    assert N.audit(nodes, whole) == 1.0
    assert abs(N.audit(nodes, half) - 20 / 45) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(3, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in N.near_duplicates(one).collect()] == [(3, 0, 3, True, 1.0)]


def test_largest_and_smallest_numbers(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [2e200, 2e200], 0), (3, [1e-200, 2e-200], 0), (4, [2e-200, 4e-200], 0), (5, [5e-324, 0.0], 0), (6, [1.7e308, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r)[:3] for r in N.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5)]


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(N, "audit", lambda *a: 0.5)
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="0.500"):
        N.near_duplicates(df, orders=1)
