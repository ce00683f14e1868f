import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("test data not present")
    return FOLDER


@pytest.fixture(scope="session")
def texts(spark, folder):
    """doc_id and text of the smallest documents table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated texts, ties, a long text and columns whose names clash."""
    rows = [
        (5, None, "en"), (4, "", None), (3, "a", "de"), (3, "a", "de"), (2, "word " * 5000, "en"), (2, "word " * 5000, "fr"),
        (1, "é" * 300, "fr"), (None, "zz top", "en"), (9, "One two three four five six seven", "en"), (8, " \t\n ", "en"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as found", "2 as row", "3 as simhash", "'k' as key", "4 as score")


