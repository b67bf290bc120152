import duckdb
import pytest

import __spark_entry__ as contract
from emberlake.adapters import BASE_TABLES
from emberlake.plans.selection import Box, Circle, Page, Selection, Span
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
SLOW = {"merged_incidents", "perimeter_pairs", "ingested_publications", "perimeter_groups", "publications_to_fires", "publications_to_incidents", "gazetteer_occurrences", "detection_groups", "detection_grid",
        "merged_footprint", "merged_roads", "road_routes", "road_parts", "incident_transitions", "road_features", "road_ways", "weather_alerts", "burnt_areas",
        "ordered_intake", "enriched_roads", "replay_outcomes", "snapshot_counts", "streamed_transitions", "gazetteer_mentions", "op1_ngram_join", "op3_embedding_dedup", "op10_mixing", "op11_resampling"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_returns_rows(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "id" and df.limit(1).count() == 1


def test_every_check_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - SLOW - {"road_routes", "local_road_lines", "nearest_km_posts", "review_decisions"}))
def test_query_agrees_with_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    cur = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("make", [
    lambda: Box.read("1,2,3"), lambda: Box(5, 0, 1, 2), lambda: Box(0, 0, 200, 1), lambda: Circle(100.0, 0.0, 10), lambda: Circle(1.0, 1.0, 300_000),
    lambda: Page(order="x"), lambda: Page(rows=500), lambda: Page(skip=-1), lambda: Selection(confidence_from=2), lambda: Selection(publisher="a"), lambda: Span(periods=frozenset({"x"})),
])
def test_bad_selections_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_filters_reach_the_scan(spark):
    plan = Box(0.0, 0.0, 5.0, 5.0).keep(spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_acctbal AS longitude", "c_acctbal AS latitude"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in text and "c_name" not in text
