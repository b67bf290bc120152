import uuid

from pyspark.sql import functions as F

from emberlake.session import DROP_SHUFFLES, cut_lineage


def test_shuffles_behind_a_copy_are_dropped(spark):
    rows = spark.range(200_000).withColumn("t", F.sha2(F.concat(F.col("id").cast("string"), F.lit(uuid.uuid4().hex)), 256)).repartition(4, "t")
    tracker = spark._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    cut = cut_lineage(rows, "kept")
    assert tracker.shuffleStatuses().size() <= before and cut.count() == 200_000
    assert spark.conf.get(DROP_SHUFFLES, "false") == "false"
