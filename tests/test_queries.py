import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, bag

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, folder, name):
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    assert rows
    if name in ORACLES:
        cursor = db.execute(ORACLES[name])
        columns = [column[0] for column in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert bag(frame.columns, rows) == bag(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["prompt_id", "n_chunks", "augmented"]
