"""Every query of the engine beside its SQL, on the small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from pricewright import plans

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(rows):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(value(x) for x in r) for r in rows), key=str)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, str(SF))
    want = duck.sql(plans.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = rows_of(df.select(*columns).collect())
    assert got == rows_of(want.select(*(f'"{c}"' for c in columns)).fetchall())
