"""Every relational query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from planweave.plans import demos

DATA = Path("/root/testdata/sf0.001")
ORACLES = demos.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value + 0.0, 9) if math.isfinite(value) else str(value)
    return float(value) if hasattr(value, "as_tuple") else value


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [str(x) for x in r])


def test_every_query_has_sql():
    assert set(ORACLES) == set(demos.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    out = demos.queries()[name](spark, str(DATA))
    columns = sorted(out.columns)
    got = rows(out.select(*[f"`{c}`" for c in columns]).collect())
    asked = duck.execute(ORACLES[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == rows([tuple(r[i] for i in at) for r in asked.fetchall()])
