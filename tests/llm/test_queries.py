import importlib.util

import duckdb
import pytest

from emberlake.llm import registry
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.all_queries())
    assert numbers == list(range(1, 14)) and set(registry.all_oracles()) <= set(registry.all_queries())


@pytest.mark.parametrize("name", sorted(registry.all_oracles()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.all_queries()[name](spark, SF)
    cur = duck.execute(registry.all_oracles()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("emberlake").origin).parent
    users = [p for p in root.rglob("*.py") if "llm" not in p.parts and "emberlake.llm" in p.read_text()]
    assert users == []
