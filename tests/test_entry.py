import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract  # noqa: E402

duckdb = pytest.importorskip("duckdb")

SF_DIR = contract.SMOKE_DIR
RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

QUERIES, SQL = contract.queries(), contract.oracle_sql()

@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def own_tests(name):
    """Queries of the training-data subpackage, which has tests of its own where it is installed."""
    return re.fullmatch(r"op\d+_\w+|pipeline", name)


def rows(values):
    return sorted(tuple(str(v) for v in row) for row in values)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert all(own_tests(q) for q in set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = database.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = rows([r[i] for i in places] for r in cursor.fetchall())
    assert rows([r[c] for c in columns] for r in df.collect()) == want


def test_flagship(spark):
    assert contract.entry(spark).columns == ["drive_id", "folder", "bytes", "files"]


@pytest.mark.parametrize("name", [
    "access_filter", "access_levels", "usage_rollup", "current_usage", "biggest_files", "query_items",
    "class_lookup", "hive_location", "storage_class_plan", "path_exists", "grid_drive_in",
])
def test_no_pairing_of_everything(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Pandas" not in plan
