"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal
from glob import glob

import duckdb
import pytest

from chordgrid.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def duck():
    con = duckdb.connect()
    for path in glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_twin(spark, duck, name):
    found = registry.QUERIES[name](spark, TABLES)
    twin = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in twin.description]
    assert sorted(found.columns) == sorted(columns)
    expected = sorted((tuple(map(plain, row)) for row in twin.fetchall()), key=repr)
    assert sorted((tuple(map(plain, row)) for row in found.select(*columns).collect()), key=repr) == expected
