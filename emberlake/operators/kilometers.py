"""Nearest kilometre posts of a road and candidate points for kilometre samples.

Posts lie in buckets of their road. Every bucket that holds posts has a rank along its
road, and the k nearest numbers of a position lie within k occupied buckets on either side
of it, so a position meets the posts of 2k + 1 buckets and never its whole road.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import units
from emberlake.operators.timeline import greatest_before

#: Kilometres per bucket, and buckets per block of a road's time line.
WIDTH, BLOCK = 2.0, 256


def numbered_posts(posts: DataFrame) -> DataFrame:
    """(road_key, post_km, post) of the posts whose number is one; comma and point both separate decimals."""
    return posts.filter(F.col("number").rlike("^[0-9]+([.,][0-9]+)?$")).select(
        F.upper("name").alias("road_key"), F.replace("number", F.lit(","), F.lit(".")).cast("double").alias("post_km"), F.col("point").alias("post")
    )


def nearest_numbers(asked: DataFrame, posts: DataFrame, k: int = 1, within: float | None = None, width: float = WIDTH) -> DataFrame:
    """(road_key, km, post_km, post) of the ``k`` posts with the closest numbers for every distinct (road_key, km).

    Posts as close as the k-th are all kept; with ``within``, posts farther off are not.
    ``posts`` is what ``numbered_posts`` gives.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    wanted = asked.select("road_key", "km").filter(F.col("km").isNotNull()).distinct().withColumn("bucket", bucket("km"))
    rows = posts.join(wanted.select("road_key").distinct(), "road_key", "left_semi").withColumn("bucket", bucket("post_km"))
    along = Window.partitionBy("road_key").orderBy("bucket")
    # One row per occupied bucket of a road goes through this window, whatever the number of posts.
    occupied = rows.select("road_key", "bucket").distinct().withColumn("rank", F.row_number().over(along).cast("long"))
    line = occupied.select("road_key", "bucket", "rank", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("km")).unionByName(
        wanted.select("road_key", "bucket", F.lit(None).cast("long").alias("rank"), F.lit(1).alias("kind"), "km")
    )
    placed = greatest_before(line.withColumn("block", F.expr(f"bucket div {BLOCK}")), ["road_key"], "block", ["bucket", "kind"], {"at": F.col("rank")})
    near = placed.filter("kind = 1").select("road_key", "km", F.explode(F.sequence(F.coalesce("at", F.lit(0)) - k, F.coalesce("at", F.lit(0)) + k)).alias("rank"))
    met = near.join(rows.join(occupied, ["road_key", "bucket"]).select("road_key", "rank", "post_km", "post"), ["road_key", "rank"])
    gap = F.abs(F.col("post_km") - F.col("km"))
    if within is not None:
        met = met.filter(gap <= within)
    best = met.withColumn("_nth", F.rank().over(Window.partitionBy("road_key", "km").orderBy(gap))).filter(F.col("_nth") <= k)
    return best.select("road_key", "km", "post_km", "post")


def sample_candidates(queries: DataFrame, posts: DataFrame, worthy: Column | None = None, step: float = 1.0, within: float = 0.5, k: int = 1) -> DataFrame:
    """(query_id, sample, samples, point): posts near every kilometre sample of a request.

    ``queries`` is (query_id, road_key, first_km, last_km); ``worthy`` picks the requests
    that are sampled. A sample without a post within ``within`` kilometres has no row.
    """
    rows = queries if worthy is None else queries.filter(worthy)
    listed = rows.filter("first_km IS NOT NULL AND last_km IS NOT NULL").withColumn("kms", units.kilometer_samples(F.col("first_km"), F.col("last_km"), step))
    sampled = listed.select("query_id", "road_key", F.size("kms").alias("samples"), F.posexplode("kms").alias("sample", "km"))
    found = nearest_numbers(sampled, numbered_posts(posts), k, within)
    return sampled.join(found, ["road_key", "km"]).select("query_id", "sample", "samples", F.col("post").alias("point"))
