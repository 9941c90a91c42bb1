"""Every registered query against its SQL on the smallest data."""

import datetime
import decimal
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sylvaframe.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.5f}" if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    """What the rows must be is held in test_iterations, test_replay, test_waves, test_branches and test_plain."""
    frame = registry.queries()[name](spark, SF)
    assert frame.columns and frame.collect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted([plain(r[c]) for c in columns] for r in frame.collect())
    answer = duck.sql(registry.oracle_sql()[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    number = lambda x: f"{float(x):.5f}" if x.lstrip("-").replace(".", "", 1).isdigit() else x  # noqa: E731  whole doubles and integers alike
    want = sorted([number(plain(r[i])) for i in places] for r in answer.fetchall())
    assert sorted([number(x) for x in row] for row in got) == want
