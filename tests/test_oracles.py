"""Every registered query of the engine against its SQL counterpart in DuckDB."""

import os

import duckdb
import pytest

from botledger.queries import ORACLE, QUERIES


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object).where(frame[cols].notna(), None)

    def cell(v):
        return str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6f}" if isinstance(v, float) else str(v)

    return cols, sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).fetchdf()
    assert rows(got) == rows(want)
