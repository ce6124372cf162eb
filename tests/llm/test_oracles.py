"""The operators that SQL can express equal DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from foliospark.llm import queries
from foliospark.session import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert want and sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want
