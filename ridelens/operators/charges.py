"""Charge status statistics and decline analysis by user and by driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions.exprs import round_half_up_ratio
from ridelens.operators.facts import TOTAL, ride_charges, ride_facts, ride_reviews, times
from ridelens.sources.tables import RideTables


def charge_status_stats(t: RideTables) -> DataFrame:
    """Q08: per charge status, distinct *reviewing* users, distinct drivers,
    rides, reviews and total usd (2 decimals).

    Drivers and reviewers are counted from (status, driver) and (status,
    reviewer) cells, which partial aggregation makes of the joined rows, so no
    row is expanded; the two cell sets meet as at most two rows a status and
    partition.  Rides and reviews count once per joined row, as `per_review`
    and the number of charges say."""
    charges = ride_charges(t).where(F.col("charge_status").isNotNull())
    rides = ride_facts(t, charges=False)
    by_driver = (charges.join(rides.select("ride_id", "driver_id", "per_review", "n_review_ids"), "ride_id")
                 .groupBy("charge_status", "driver_id").agg(
                     F.sum(F.col("n_charges") * F.col("per_review")).alias("rides"),
                     F.sum(F.col("n_charges") * F.coalesce("n_review_ids", F.lit(0))).alias("reviews"),
                     F.sum(times("usd", "per_review")).alias("usd")))
    reviewed = (ride_reviews(t).select("ride_id", "reviewer_id")
                .join(t.ride_requests.select("ride_id"), "ride_id")
                .join(charges.select("ride_id", "charge_status"), "ride_id")
                .select("charge_status", "reviewer_id").distinct())
    drivers = by_driver.groupBy("charge_status").agg(
        F.lit(None).cast("bigint").alias("users"), F.count("driver_id").alias("drivers"),
        *[F.sum(c).alias(c) for c in ("rides", "reviews", "usd")])
    users = reviewed.groupBy("charge_status").agg(
        F.count("reviewer_id").alias("users"), *[F.lit(None).cast("bigint").alias(c) for c in
                                                 ("drivers", "rides", "reviews")],
        F.lit(None).cast(TOTAL).alias("usd"))
    return (drivers.unionByName(users).groupBy("charge_status").agg(
        F.coalesce(F.sum("users"), F.lit(0)).alias("users"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("drivers", "rides", "reviews")],
        F.round(F.sum("usd"), 2).cast("double").alias("total_usd")))


def decline_cells(t: RideTables, key: str) -> DataFrame:
    """Q09 (`key="user_id"`) or Q10 (`key="driver_id"`) rows without the
    presentation sort, for consumers that reshape them further."""
    other, other_name = (("driver_id", "unique_drivers") if key == "user_id"
                         else ("user_id", "unique_users"))
    return _declines(t, key, other, other_name, ordered=False)


def _declines(t: RideTables, key: str, other: str, other_name: str,
              ordered: bool = True) -> DataFrame:
    """Over one row per ride: rides are counted plainly and only `other` needs a
    distinct count, so no row is expanded.  A ride's declines count once per
    review of it, as in the joined tables."""
    f = ride_facts(t)

    def joined_usd(c: str) -> Column:
        return F.coalesce(F.sum(times(c, "per_review")), F.lit(0).cast(TOTAL)).cast("double")
    out = (f.groupBy(key)
           .agg(F.count_distinct(other).alias(other_name),
                F.count("ride_id").alias("unique_rides"),
                F.sum(F.coalesce("n_declined", F.lit(0)) * F.col("per_review")).alias("decline_count"),
                round_half_up_ratio(F.sum(F.col("rating_sum") * F.col("n_declined")),
                                    F.sum(F.col("rating_n") * F.col("n_declined")), 2).alias("avg_rating"),
                joined_usd("declined_usd").alias("lost_total_usd"),
                joined_usd("approved_usd").alias("gained_total_usd"))
           .where(F.col("decline_count") > 1))
    if not ordered:
        return out
    return out.orderBy(F.col("decline_count").desc(), F.col(key).asc_nulls_last())


def user_declines(t: RideTables) -> DataFrame:
    """Q09: users with more than one declined charge.  Counts cover all of the
    user's rides; the rating mean covers declined rides only."""
    return _declines(t, "user_id", "driver_id", "unique_drivers")


def driver_declines(t: RideTables) -> DataFrame:
    """Q10: the same per driver (a NULL driver forms its own group)."""
    return _declines(t, "driver_id", "user_id", "unique_users")
