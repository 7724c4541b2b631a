"""Queries on values that only larger tables have, against their SQL."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessellon.functions import render
from tests.test_functions import one


def test_fmt_f64_of_large_ids(spark, tmp_path):
    ids = [3, *range(999_990, 1_000_020), *range(5_999_990, 6_000_010), *range(10_000_000, 10_000_020), 123_456_789_010]
    events = spark.createDataFrame([(i, v) for i in ids for v in (i / 100, -i * 1e9, i * 1e12)], "event_id long, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["fmt_f64"]).fetchall()
    got = entry.queries()["fmt_f64"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3 * len(ids)


def test_numbers_up_to_another_power(spark):
    for x, want in [(1e15, "1000000000000000.0"), (-1.5e15, "-1500000000000000.0"), (1000000000000000.2, "1000000000000000.2"), (1e16, "1E+16"), (24.0, "24"), (1.5e-7, "1.5E-07")]:
        assert one(spark, render.format_double(F.col("x"), huge=1e16), x=x) == want
