"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from periodika import plans


def _plain(x) -> str:
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    try:
        return repr(round(float(x), 6))
    except (TypeError, ValueError):
        return str(x)


def _rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(x) for x in row) for row in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_oracle(name, spark, small, duck):
    got, want = plans.QUERIES[name](spark, small).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_oracle_runs(name, spark, small):
    plans.QUERIES[name](spark, small).count()


@pytest.mark.parametrize("name", ["st2_admit_stream", "st2_admit_batches"])
def test_admission_of_busy_minutes_in_many_files(name, spark, tmp_path):
    """Requests a fraction of a second apart, in 70 files in no order of time: a minute's counters are those of the minute on the clock."""
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:20' + i * INTERVAL 1700 MILLISECOND AS ts, i % 2 AS user_id, 'view' AS event_type, CAST(70 + i % 3 AS DOUBLE) AS value, (i * 37 % 70)::INT AS part FROM range(140) t(i))
        TO '{tmp_path}/split' (FORMAT parquet, PARTITION_BY (part))""")
    (tmp_path / "events.parquet").mkdir()
    for i, f in enumerate(sorted((tmp_path / "split").rglob("*.parquet"))):
        (tmp_path / "events.parquet" / f"{i}.parquet").write_bytes(f.read_bytes())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(plans.ORACLES[name]).df()
    assert _rows(got) == _rows(want) and {"minute", "day"} <= set(got["reason"])
