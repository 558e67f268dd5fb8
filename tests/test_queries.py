"""Every query with SQL gives DuckDB's rows; those without give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from geoaudit.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
