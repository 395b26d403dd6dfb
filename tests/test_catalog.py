"""Each query against its DuckDB statement on the smallest tables."""

from numbers import Number
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from docloom.plans import answers, legal, scans  # noqa: F401  they add to both tables
from docloom.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(frame, columns):
    out = []
    for row in frame[columns].itertuples(index=False):
        out.append(tuple("null" if pd.api.types.is_scalar(v) and pd.isna(v) else repr(round(float(v), 5) + 0.0) if isinstance(v, Number) and not isinstance(v, bool) else str(v)[:26] if "Timestamp" in type(v).__name__ else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
