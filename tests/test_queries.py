"""Every catalogue query against its SQL in DuckDB."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from siltbed.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 6)) if isinstance(x, float | Decimal) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.execute(catalog.oracle_sql()[name])
    assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())
