"""Every registered query with an oracle equals DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from foliospark.plans import archives, logs, markup, places, trees  # noqa: F401 (they register their queries in the catalogue)
from foliospark.plans.catalogue import ORACLES, QUERIES
from foliospark.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want
