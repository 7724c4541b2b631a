"""Small tables with the awkward cases: nulls, empty and very long texts, repeated rows, extra columns."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def table(name="documents", columns="*", sf=SF):
    path = f"{sf}/{name}.parquet"
    return duckdb.sql(f"select {columns} from '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'").fetchall()


AWKWARD = [
    (1, "The quick brown fox, it's 12 o'clock."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "café Ünïcode ΣΑΣ 漢字 🙂 <|endoftext|> a  b"),
    (6, "word " * 30_000),
    (7, "x" * 50_000),
    (8, "The quick brown fox, it's 12 o'clock."),
    (8, "The quick brown fox, it's 12 o'clock."),
]
SCHEMA = "doc_id long, text string, id string, piece int, length long, ids string, bucket int, flag int, component_id long"


def awkward(spark, rows=AWKWARD):
    """Rows with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4, 5) for r in rows], SCHEMA)
