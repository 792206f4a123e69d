"""Driver rating distribution (driver x age x platform) and per-driver summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.functions.exprs import mean_half_up, round_half_up_ratio
from ridelens.operators.facts import ride_facts, user_dim
from ridelens.sources.tables import RideTables


def _driver_user_cells(t: RideTables) -> DataFrame:
    """Rides (with their reviews) reduced to one row per (driver, user).

    Drop-offs and cancellations count once per review of their ride, as in the
    joined tables; the result is far smaller than the ride table and is what
    meets the user dimension."""
    def per_review(c: str):
        return F.sum(F.when(F.col(c).isNotNull(), F.col("per_review")).otherwise(0))
    return (ride_facts(t, charges=False).groupBy("driver_id", "user_id")
            .agg(F.count("ride_id").alias("rides"),
                 per_review("dropoff_ts").alias("rides_completed"),
                 per_review("cancel_ts").alias("rides_canceled"),
                 F.sum(F.coalesce("n_review_ids", F.lit(0))).alias("reviews"),
                 F.sum("rating_sum").alias("rating_sum"),
                 F.sum(F.coalesce("rating_n", F.lit(0))).alias("rating_n")))


def _distribution(t: RideTables) -> DataFrame:
    users = user_dim(t).select("user_id", "age_range", "platform")
    return (_driver_user_cells(t).join(users, "user_id", "left")
            .groupBy("driver_id", "age_range", "platform")
            .agg(F.count("user_id").alias("users"),
                 F.sum("rides").alias("rides"),
                 F.sum("rides_completed").alias("rides_completed"),
                 F.sum("rides_canceled").alias("rides_canceled"),
                 F.sum("reviews").alias("reviews"),
                 round_half_up_ratio(F.sum("rating_sum"), F.sum("rating_n"), 2,
                                     as_double=False).alias("avg_rating")))


def driver_rating_distribution(t: RideTables) -> DataFrame:
    """Q11: users, rides, completed, cancelled, reviews and rounded mean rating
    per driver x age_range x platform."""
    return _distribution(t).select(
        "driver_id", "users", "rides", "rides_completed", "rides_canceled",
        "age_range", "platform", "reviews", F.col("avg_rating").cast("double").alias("avg_rating"))


def driver_rating_summary(t: RideTables) -> DataFrame:
    """Q12: sums of Q11 per driver and the unweighted mean of its rounded
    per-segment means (two decimals, HALF_UP)."""
    return summarise(_distribution(t))


def summarise(distribution: DataFrame) -> DataFrame:
    """Q12 from the rows of Q11 (computed or stored)."""
    return (distribution.groupBy("driver_id")
            .agg(F.sum("rides").alias("total_rides"),
                 F.sum("users").alias("total_users"),
                 F.sum("rides_completed").alias("rides_completed"),
                 F.sum("rides_canceled").alias("rides_canceled"),
                 F.sum("reviews").alias("reviews"),
                 mean_half_up(F.col("avg_rating"), 2, scale=2).alias("avg_ratings")))

