"""Every engine query against its SQL on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__
from causeway import expected, fixtures, literal, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


SQL = queries.ORACLE_SQL | expected.ORACLE_SQL
FOUND = queries.QUERIES | fixtures.QUERIES | literal.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    got = FOUND[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(map(plain, r)) for r in got.select(names).collect()) == want


@pytest.mark.parametrize("name", ["keep_best", "weighted_vote", "enclosing_range", "nearest_match", "promote_best"])
def test_partitions_change_nothing(spark, name, monkeypatch):
    one = sorted(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    read = queries.t
    monkeypatch.setattr(queries, "t", lambda s, d, n: read(s, d, n).repartition(5))
    assert sorted(map(str, map(tuple, queries.QUERIES[name](spark, SF).collect()))) == sorted(map(str, one))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"lang", "rank", "score", "label"} <= set(df.columns)


def test_all_have_names():
    found = __spark_entry__.queries()
    assert set(FOUND) <= set(found)
    assert all(re.fullmatch(r"\w+", q) for q in found)


def test_scans_read_what_they_need(spark):
    plan = queries.QUERIES["semi_join"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]
