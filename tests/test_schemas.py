import pytest
from pyspark.sql import functions as F

from emberlake import schemas


@pytest.mark.parametrize("table", schemas.TABLES)
def test_every_schema_builds_and_conforms(spark, table):
    out = schemas.conform(spark.range(1).withColumn("confidence", F.lit("0.5")), table)
    assert out.schema.names == schemas.schema(table).names and out.count() == 1


def test_spatial_tables_carry_geometry_and_ids_repeat(spark):
    assert {"geometry", "xmin"} <= set(schemas.schema("fire_perimeters").names) and "geometry" not in schemas.schema("official_notices").names
    one = spark.range(1).select(schemas.record_id(F.lit("s"), F.lit("x")).alias("v")).first().v
    assert one == spark.range(1).select(schemas.record_id(F.lit("s"), F.lit("x")).alias("v")).first().v
