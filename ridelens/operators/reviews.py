"""Review statistics by rating, unreviewed rides, reviews per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.operators.facts import ride_charges, ride_reviews, times
from ridelens.sources.tables import RideTables


def rides_without_reviews(t: RideTables) -> DataFrame:
    """Q14: ride ids that have no review (a direct anti-join; Catalyst would
    keep an outer join plus IS NULL filter as written in SQL); stored rides know
    it themselves."""
    if t.cells:
        return t.cells["rides"].where(F.col("n_reviews").isNull()).select("ride_id")
    return t.ride_requests.select("ride_id").join(
        t.reviews.select("ride_id"), "ride_id", "left_anti")


def review_rating_stats(t: RideTables) -> DataFrame:
    """Q13: per rating, distinct reviewers, rides, reviews and usd; plus one
    row with NULL rating (and NULL reviews) for the rides nobody reviewed.

    Rides and reviews each meet the charges of their ride (reduced to number and
    sum, so nothing fans out) before the full join of the two, all partitioned by
    ride, then one aggregate: every table is shuffled by ride once, and stored
    cells not at all.  The row of unreviewed rides is
    there even when all rides have reviews, with 0 users and rides."""
    charges = ride_charges(t).groupBy("ride_id").agg(
        F.sum("n_charges").alias("n_charges"), F.sum("usd").alias("usd"))
    rides = t.cells["rides"] if t.cells else t.ride_requests.join(charges, "ride_id", "left")
    rides = rides.select("ride_id", F.col("user_id").alias("rider_id"), F.col("ride_id").alias("known_ride_id"),
                         F.col("n_charges").alias("n_charges_1"), F.col("usd").alias("usd_1"))
    reviews = (ride_reviews(t).join(charges, "ride_id", "left").withColumn("reviewed", F.lit(True))
               .withColumnsRenamed({"n_charges": "n_charges_2", "usd": "usd_2"}))
    joined = rides.join(reviews, "ride_id", "full").withColumns({
        "reviewed": F.coalesce("reviewed", F.lit(False)), "usd": F.coalesce("usd_1", "usd_2"),
        "times": F.coalesce("n_charges_1", "n_charges_2", F.lit(1)), "n_reviews": F.coalesce("n_reviews", F.lit(1))})
    if t.cells:  # reviews without a ride id meet no ride and no charge
        lost = t.cells["lost_reviews"].withColumns({"reviewed": F.lit(True), "times": F.lit(1).cast("bigint")})
        joined = joined.unionByName(lost, allowMissingColumns=True)
    person = F.when(F.col("reviewed"), F.col("reviewer_id")).otherwise(F.col("rider_id"))
    known = F.col("known_ride_id").isNotNull()
    cells = (joined.groupBy("reviewed", "rating")
             .agg(F.count_distinct(person).alias("users"),
                  F.sum(F.when(known, F.col("times") * F.col("n_reviews")).otherwise(0)).alias("rides"),
                  F.sum(F.col("times") * F.coalesce("n_review_ids", F.lit(0))).alias("reviews"),
                  F.sum(times("usd", "n_reviews")).alias("usd")))
    none = t.ride_requests.sparkSession.range(1).select(
        F.lit(False).alias("reviewed"), F.lit(None).cast("int").alias("rating"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("users", "rides", "reviews")],
        F.lit(None).cast("decimal(38,8)").alias("usd"))
    return (cells.unionByName(none).groupBy("reviewed", "rating")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("users", "rides", "reviews")],
                 F.sum("usd").cast("double").alias("total_usd"))
            .select("rating", "users", "rides", F.when(F.col("reviewed"), F.col("reviews")).alias("reviews"),
                    "total_usd"))


def reviews_per_user(t: RideTables) -> DataFrame:
    """Reviews written by each user."""
    return (t.reviews.groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("review_count")))
