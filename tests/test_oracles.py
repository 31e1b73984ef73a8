"""Every registered query of the quantification operators that has SQL gives what DuckDB gives for it on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quantgrid.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # integration needs two samples or more in each batch
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    def at(sf: str) -> duckdb.DuckDBPyConnection:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return con

    return {sf: at(sf) for sf in (SF, LARGER)}


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, duck, name):
    sf = LARGER if name.startswith("integrate_") else SF
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck[sf].execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, LARGER).count() > 0
