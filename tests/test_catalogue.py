"""Every catalogue query against its DuckDB statement, on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TABLES}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return None if value is None else str(value)


@pytest.mark.parametrize("key", sorted(catalogue.oracle_sql()))
def test_matches(spark, oracle, key):
    mine = catalogue.queries()[key](spark, TABLES)
    theirs = oracle.execute(catalogue.oracle_sql()[key])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    order = sorted(names)
    a = sorted(([plain(r[c]) for c in order] for r in (x.asDict() for x in mine.collect())), key=repr)
    b = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in order] for r in theirs.fetchall()), key=repr)
    assert a == b


def test_each_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
