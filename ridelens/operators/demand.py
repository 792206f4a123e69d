"""Request demand and per-user ride counts.

All three are single hash aggregations: partial (map-side) aggregation
collapses each key inside every input task, so even a user holding a third
of all rides ships one partial row per task to the final aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.sources.tables import RideTables


def requests_by_hour(t: RideTables) -> DataFrame:
    """Q06: ride requests per hour of day (surge-pricing question)."""
    return (t.ride_requests
            .groupBy(F.hour("request_ts").cast("int").alias("request_hour"))
            .agg(F.count(F.lit(1)).alias("num_requests"))
            .orderBy("request_hour"))


def ride_counts(t: RideTables) -> DataFrame:
    """Q07 without the presentation sort, for consumers that go on."""
    return t.ride_requests.groupBy("user_id").agg(F.count("ride_id").alias("rides"))


def rides_per_user(t: RideTables) -> DataFrame:
    """Q07: rides requested per user, fewest first (user id breaks ties), by a
    distributed range sort."""
    return ride_counts(t).orderBy(F.col("rides").asc(), F.col("user_id").asc_nulls_last())


def user_ride_stats(t: RideTables) -> DataFrame:
    """Q16: total, completed and cancelled rides per user."""
    return (t.ride_requests.groupBy("user_id")
            .agg(F.count("ride_id").alias("total_rides"),
                 F.count("dropoff_ts").alias("rides_completed"),
                 F.count("cancel_ts").alias("rides_canceled")))
