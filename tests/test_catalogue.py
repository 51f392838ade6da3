import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue
from tessera.sources.tables import NAMES

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def same(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert name == "full_join" or got.limit(1).count(), "no rows: the comparison would prove nothing"
    rows = lambda data: sorted((tuple(same(v) for v in r) for r in data), key=str)
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect()) == rows(want.fetchall())


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_llm():
    root = Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
