"""Registered queries against their DuckDB statements."""

from pathlib import Path

import duckdb
import pytest

from docloom.llm.catalog import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
