"""Every registered query of the library against its SQL, at the smallest size."""

import datetime
import decimal
import os

import duckdb
import pytest

from panelwright import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if v != v else f"{v:.6g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    expected = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 120
    assert os.path.isdir(SF)
