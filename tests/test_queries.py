"""Registered array queries against their SQL."""

import os

import duckdb
import pytest

from cubeframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if v[i] is None else v[i] for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    made = plans.QUERIES[name](spark, SF)
    got = rows(made.columns, made.collect())
    if name not in plans.ORACLES:
        assert got
        return
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(plans.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(made.columns)
        assert got == rows(names, found.fetchall())


def test_flagship(spark):
    assert plans.flagship(spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
