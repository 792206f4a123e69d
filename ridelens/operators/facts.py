"""Shared building blocks: the user dimension and ride-keyed enrichments.

Scale notes.  `signups` and `app_downloads` grow with the user base (billions
of rows at the target size), so nothing here is broadcast by hand; AQE turns
a join into a broadcast only when its runtime size is below
`spark.sql.autoBroadcastJoinThreshold`.  Ride-keyed joins (transactions,
reviews) share one hash partitioning on `ride_id`, so the three inputs are
each shuffled once.  Operators aggregate ride facts down to user grain
*before* joining the user dimension, so that join is user-sized on both
sides and a hot user (many rides) is collapsed by map-side partial
aggregation instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions.exprs import USD, usd
from ridelens.sources.tables import RideTables

TOTAL = "decimal(38,8)"  # sums of money


def user_dim(t: RideTables) -> DataFrame:
    """signups with their download platform: user_id, age_range, platform, signup_ts.

    A signup whose session has no download keeps a NULL platform."""
    s = t.signups.select("user_id", "session_id", "signup_ts", "age_range")
    ad = t.app_downloads.select(F.col("app_download_key").alias("session_id"), "platform")
    return s.join(ad, "session_id", "left").drop("session_id")


def rider_status(t: RideTables) -> DataFrame:
    """One row per distinct (rider, age_range, platform); riders missing from
    signups get NULL age and platform."""
    riders = t.ride_requests.select("user_id").distinct()
    users = user_dim(t).select("user_id", "age_range", "platform")
    return riders.join(users, "user_id", "left").distinct()


def ride_facts(t: RideTables, charges: bool = True) -> DataFrame:
    """One row per ride with the sums of its charges (if wanted) and reviews.

    Charges and reviews are each reduced per ride before they meet it, so all
    three sides shuffle once, on ride_id, and nothing fans out.  Joining the
    raw tables instead would give every charge once per review (and back):
    `per_review` and `per_charge` are those multiplicities, with which sums
    over the joined rows are restored exactly.  Stored rides have all of it."""
    if t.cells:
        return t.cells["rides"]
    one = F.lit(1).cast("bigint")
    reviews = t.reviews.groupBy("ride_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count("review_id").alias("n_review_ids"),
        F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_n"))
    out = (t.ride_requests.join(reviews, "ride_id", "left")
           .withColumn("per_review", F.greatest(F.coalesce("n_reviews", F.lit(0)), one)))
    if not charges:
        return out
    declined, approved = F.col("charge_status") == "Decline", F.col("charge_status") == "Approved"
    money = usd("purchase_amount_usd")
    sums = t.transactions.groupBy("ride_id").agg(
        F.count(F.lit(1)).alias("n_charges"),
        F.count(F.when(declined, 1)).alias("n_declined"),
        F.count(F.when(approved, 1)).alias("n_approved"),
        F.sum(F.when(declined, money)).alias("declined_usd"),
        F.sum(F.when(approved, money)).alias("approved_usd"),
        F.sum(money).alias("usd"))
    return (out.join(sums, "ride_id", "left")
            .withColumn("per_charge", F.greatest(F.coalesce("n_charges", F.lit(0)), one)))


def ride_charges(t: RideTables) -> DataFrame:
    """ride_id, charge_status, n_charges, usd: raw rows, or the stored cells
    (one row per ride and status)."""
    if t.cells:
        return t.cells["charges"]
    return t.transactions.select("ride_id", "charge_status", F.lit(1).cast("bigint").alias("n_charges"),
                                 usd("purchase_amount_usd").cast(TOTAL).alias("usd"))


def ride_reviews(t: RideTables) -> DataFrame:
    """ride_id, reviewer_id, rating, n_reviews, n_review_ids: raw rows, or the
    stored cells (one row per ride, reviewer and rating)."""
    if t.cells:
        return t.cells["reviews"]
    return t.reviews.select("ride_id", F.col("user_id").alias("reviewer_id"), "rating",
                            F.lit(1).cast("bigint").alias("n_reviews"),
                            F.col("review_id").isNotNull().cast("bigint").alias("n_review_ids"))


def times(money: str, factor: Column | str) -> Column:
    """A sum of money once per joined row: 28 + 9 digits, so the product keeps
    all eight decimals."""
    return F.col(money).cast(USD) * (F.col(factor) if isinstance(factor, str) else factor).cast("decimal(9,0)")
