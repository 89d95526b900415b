"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    files = glob.glob(f"{data}/*.parquet")
    if not files:
        pytest.skip("no sample tables")
    con = duckdb.connect()
    for path in files:
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(picked, key=repr)


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not [name for part in contract.OWN_PARTS for name in part.QUERIES if name not in ORACLES]


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert canonical(got.columns, got.collect()) == canonical(columns, want.fetchall())
