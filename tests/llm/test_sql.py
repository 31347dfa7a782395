"""The operators that SQL can express against DuckDB, on provided tables and on odd ones."""

import os

import duckdb
import pytest

from llm import test_url_filter, test_warc
from nearhome.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    number = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted([number(v) for v in row] for row in frame.values.tolist())


def compare(spark, name, folder):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        path = f"{folder}/{file}" + ("/*.parquet" if os.path.isdir(f"{folder}/{file}") else "")
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found, expected = queries.QUERIES[name](spark, folder).toPandas(), connection.sql(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) and plain(found) == plain(expected)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_provided_tables(spark, name):
    compare(spark, name, SF_DIR)


def test_odd_urls(spark, folder):
    site = [f"http://{h}{p}" for h, p, _ in test_url_filter.SITE if h]
    rules = [f"https://a{i % 3}.net/{('es', 'fr', 'en')[i % 3]}/{i}.html" for i in range(90)] + [f"https://b.net/{i % 4 and 'es'}/{i}" for i in range(90)]
    compare(spark, "op9_url_filter", folder(pages=test_url_filter.pages(spark, test_url_filter.ODD + site + rules)))


def test_odd_pages(spark, folder):
    rows = {(i, h): (i, u, h) for i, u, h in test_warc.ODD if i is not None}  # SQL has no word on repeated rows and null ids
    compare(spark, "op10_warc", folder(pages=test_warc.pages(spark, list(rows.values()))))
