"""Every registered query against its DuckDB SQL on the smallest data."""

import math
import os

import duckdb
import pytest

from phylospark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def same(rows, expected):
    assert sorted(rows.columns) == sorted(expected.columns)
    names = sorted(rows.columns)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.7g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    a, b = (sorted(tuple(plain(v) for v in r) for r in x[names].itertuples(index=False)) for x in (rows, expected))
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    same(catalog.queries()[name](spark, SF).toPandas(), con.execute(catalog.oracle_sql()[name]).df())
