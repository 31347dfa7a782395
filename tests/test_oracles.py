"""Every registered query against its SQL in DuckDB, on the smallest provided tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from nearhome.plans.catalog import QUERIES
from nearhome.plans.oracles import SQL

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).astype(str).values.tolist()


def test_every_sql_has_its_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(SQL) <= set(entry_point.oracle_sql()) and set(QUERIES) <= set(entry_point.queries())
    assert set(QUERIES) - set(SQL) == {"als_user_recs"}


@pytest.mark.parametrize("error", [ModuleNotFoundError(name="nearhome.llm"), ModuleNotFoundError(name="public_tokenizers"), ImportError("cannot import name 'x'")])
def test_entry_without_the_optional_queries(monkeypatch, capsys, error):
    def missing(name):
        raise error

    monkeypatch.setattr(entry_point.importlib, "import_module", missing)
    assert set(entry_point.queries()) == set(QUERIES) and "left out" in capsys.readouterr().err
    assert set(entry_point.queries()) == set(QUERIES) and set(entry_point.oracle_sql()) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    found = df.toPandas()
    assert len(found)
    if name in entry_point.oracle_sql():
        expected = tables.sql(entry_point.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert plain(found) == plain(expected)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["announce_id", "user_id"] and df.count() > 0
