import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def test_burnt_areas_are_parsed_once_on_all_cores(spark):
    """One split is spread before parsing, and no filter brings a copy of the parsing below it."""
    df = contract.queries()["burnt_areas"](spark, SF)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and plan.index("StructsToJsonEvaluator") < plan.index("Repartition")
