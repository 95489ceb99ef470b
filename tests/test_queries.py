"""Every own query against its SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from lithos import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = own.queries()[name](spark, SF)
    want = duck.execute(own.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(own.queries()) == set(own.oracle_sql())


def test_nearest_modes_differ(spark):
    from lithos.operators import versions

    rows = spark.createDataFrame([(1, 5, 0, 50), (1, 10, 7, 107)], "segment long, versiontime long, uniquifier int, versionid long")
    target = spark.createDataFrame([(1, 15, 0)], "segment long, at_time long, at_uniquifier int")
    assert versions.nearest(rows, target).first()["versionid"] == 107
    assert versions.nearest(rows, target, "component").first()["versionid"] == 50
