"""Every query of the workbench on the smallest tables against its check SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from check import canonical
from workbench.queries import QUERIES
from workbench.roles import TABLES

FOLDER = entry_points.SMALL
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return base


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    cursor = database.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200


def test_core_is_registered_without_the_optional_packages():
    """In a process of its own, where a package that only the optional part needs cannot be imported."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.queries()) ^ set(e.oracle_sql())))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry_points.__file__), check=True)
    assert done.stdout.strip() == f"{len(QUERIES)} []"
