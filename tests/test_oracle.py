"""Every query with SQL, against DuckDB on the tables of sf0.01; floats may differ by their last digits only."""

import math
from pathlib import Path

import duckdb
import pytest

from tripleweft.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    """Rows with their columns by name, in an order that the last digits of floats don't change."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: f"{v:.6g}" if isinstance(v, float) else repr(v)
    return sorted(([r[i] for i in order] for r in values), key=lambda r: [key(v) for v in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) or a != a and b != b
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in SQL:
        found = duck.sql(SQL[name])
        want = rows(found.columns, found.fetchall())
        assert sorted(df.columns) == sorted(found.columns)
        assert len(got) == len(want)
        bad = [(a, b) for a, b in zip(got, want) if not all(same(x, y) for x, y in zip(a, b))]
        assert not bad, bad[:3]
