"""Every query with an oracle gives DuckDB's rows: same columns, same values, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_parity(spark, con, tmp_path, name):
    out = str(tmp_path / name)
    entry.queries()[name](spark, SF).write.parquet(out)
    con.execute(f"CREATE OR REPLACE TABLE o AS {entry.oracle_sql()[name]}")
    con.execute(f"CREATE OR REPLACE TABLE g AS SELECT * FROM '{out}/*.parquet'")
    kinds = [{c[0]: c[1] for c in con.execute(f"DESCRIBE {t}").fetchall()} for t in "og"]
    assert kinds[0].keys() == kinds[1].keys()
    cols = ",".join(f'"{c}"' for c in kinds[0])
    for a, b in ("og", "go"):
        assert con.execute(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchone()[0] == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
