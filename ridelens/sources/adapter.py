"""Derive the five ride tables from the driver's star-schema test tables.

The real sources are not available, so `customer` becomes app downloads and
signups and `orders` becomes ride requests, transactions and reviews, through
deterministic integer arithmetic (see FIXTURES.md section 3).  Every choice
is a pure per-row expression, so the derivation is a narrow, map-only stage
over each scan: no shuffle, no broadcast, and Spark prunes the columns it
does not need.  The same mapping is repeated as SQL in `plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from ridelens.sources.tables import RideTables

# Fixed values of the mapping (FIXTURES.md section 3).
SEGMENT_AGE = {
    "AUTOMOBILE": "18-24",
    "BUILDING": "25-34",
    "FURNITURE": "35-44",
    "HOUSEHOLD": "45-54",
}
DOWNLOAD_EPOCH = "1994-01-01 00:00:00"

# The columns of the driver tables the mapping reads.  Declaring them skips
# Parquet schema inference (a Spark job per read) and prunes the scan.
CUSTOMER_COLUMNS = StructType([
    StructField("c_custkey", LongType()),
    StructField("c_mktsegment", StringType()),
])
ORDERS_COLUMNS = StructType([
    StructField("o_orderkey", LongType()),
    StructField("o_custkey", LongType()),
    StructField("o_totalprice", DoubleType()),
    StructField("o_orderdate", TimestampNTZType()),
])


def _keeps_signup(custkey: Column) -> Column:
    return custkey * 53 % 103 % 4 != 3


def _platform(custkey: Column) -> Column:
    bucket = custkey * 37 % 101 % 10
    return (F.when(bucket < 3, F.lit("android"))
            .when(bucket < 9, F.lit("ios"))
            .otherwise(F.lit("web")))


def _age_range(segment: Column) -> Column:
    pairs = list(SEGMENT_AGE.items())
    expr = F.when(segment == pairs[0][0], F.lit(pairs[0][1]))
    for name, age in pairs[1:]:
        expr = expr.when(segment == name, F.lit(age))
    return expr.otherwise(F.lit("Unknown"))


def _request_hour(orderkey: Column) -> Column:
    mod5 = orderkey % 5
    return (F.when(mod5 < 2, 8 + orderkey % 3)
            .when(mod5 == 2, 16 + orderkey % 4)
            .otherwise(orderkey * 7 % 24))


def _rider(custkey: Column) -> Column:
    """The customer who rides: three in ten customers never do, and their
    orders go to the next one who does.  No order is left out; riders without a
    signup (or without any customer row) are the rides of unknown users."""
    def rides(key: Column) -> Column:
        return key * 59 % 107 % 10 < 7
    return (F.when(rides(custkey), custkey).when(rides(custkey + 1), custkey + 1)
            .when(rides(custkey + 2), custkey + 2).otherwise(custkey + 3))


def downloads_and_signups(customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    epoch = F.lit(DOWNLOAD_EPOCH).cast("timestamp_ntz")
    download_ts = epoch + F.make_dt_interval(days=(key % 180).cast("int"))
    app_downloads = customer.select(
        F.concat(F.lit("dl-"), key.cast("string")).alias("app_download_key"),
        _platform(key).alias("platform"),
        download_ts.alias("download_ts"),
    )
    signups = customer.where(_keeps_signup(key)).select(
        key.cast("bigint").alias("user_id"),
        F.concat(F.lit("dl-"), key.cast("string")).alias("session_id"),
        (download_ts + F.make_dt_interval(days=(key % 7).cast("int"))).alias("signup_ts"),
        _age_range(F.col("c_mktsegment")).alias("age_range"),
    )
    return app_downloads, signups


def rides_transactions_reviews(orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    okey, ckey = F.col("o_orderkey"), F.col("o_custkey")
    request_ts = (F.col("o_orderdate").cast("timestamp_ntz")
                  + F.make_dt_interval(hours=_request_hour(okey).cast("int")))
    rider = _rider(ckey)
    cancelled = (okey * 73 % 137 % 10 < 2) | (rider * 61 % 109 % 2 == 0)
    rides = (orders
             .select(
                 okey.cast("bigint").alias("ride_id"),
                 rider.cast("bigint").alias("user_id"),
                 (1 + (okey * 7 + ckey) % 997).cast("bigint").alias("driver_id"),
                 request_ts.alias("request_ts"),
                 F.when(~cancelled, request_ts + F.make_dt_interval(
                     mins=(5 + okey % 60).cast("int"))).alias("dropoff_ts"),
                 F.when(cancelled, request_ts + F.make_dt_interval(
                     mins=(1 + okey % 9).cast("int"))).alias("cancel_ts"),
                 F.col("o_totalprice").alias("_price"),
             ))
    done = rides.where(F.col("dropoff_ts").isNotNull())
    transactions = done.select(
        "ride_id",
        F.col("_price").cast("double").alias("purchase_amount_usd"),
        F.when(F.col("ride_id") * 71 % 131 % 20 == 0, F.lit("Decline"))
         .otherwise(F.lit("Approved")).alias("charge_status"),
    )
    reviews = done.where(F.col("ride_id") * 67 % 127 % 10 < 7).select(
        (F.lit(1000000) + F.col("ride_id")).cast("bigint").alias("review_id"),
        "ride_id",
        "user_id",
        (1 + F.col("ride_id") * 13 % 113 % 5).cast("int").alias("rating"),
    )
    return rides.drop("_price"), transactions, reviews


def from_driver_tables(spark: SparkSession, sf_dir: str) -> RideTables:
    """Five ride tables over `/root/testdata/sf*/{customer,orders}.parquet`,
    each built on first use."""
    cache: dict[str, tuple[DataFrame, ...]] = {}

    def customer_side() -> tuple[DataFrame, DataFrame]:
        if "c" not in cache:
            customer = spark.read.schema(CUSTOMER_COLUMNS).parquet(f"{sf_dir}/customer.parquet")
            cache["c"] = downloads_and_signups(customer)
        return cache["c"]

    def orders_side() -> tuple[DataFrame, DataFrame, DataFrame]:
        if "o" not in cache:
            orders = spark.read.schema(ORDERS_COLUMNS).parquet(f"{sf_dir}/orders.parquet")
            cache["o"] = rides_transactions_reviews(orders)
        return cache["o"]

    return RideTables(lambda: customer_side()[0], lambda: customer_side()[1],
                      lambda: orders_side()[0], lambda: orders_side()[1],
                      lambda: orders_side()[2])
