"""Progress of runs without a header, or without any line that tells a stage."""

import datetime as dt

import pytest

from tests.check import compare
from tidemark.catalog import cases

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def odd_runs(spark, tmp_path):
    """Runs 1 and 2 tell stages but no header, 3 and 4 only other lines, 5 and 6 all."""
    told = {1: [1, 6], 2: [9, 14], 3: [7], 4: [15], 5: [16, 17], 6: [24, 25]}
    rows = [(i, dt.datetime(2024, 1, 1, i), user, "click", 100.0 + i, "") for user, ids in told.items() for i in ids if i < 24]
    rows += [(i, dt.datetime(2024, 1, 2, i - 24), 6, "click", 100.0 + i, "") for i in (24, 25)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["st4_progress_batch", "st4_progress_stream", "st4_time_left"])
def test_runs_without_header(spark, odd_runs, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_runs}/events.parquet/*.parquet'")
    case = cases()[name]
    assert compare(con, case.run(spark, odd_runs), case.sql) is None
