"""Fixed schemas of the five source tables (never inferred)."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

APP_DOWNLOADS = StructType([
    StructField("app_download_key", StringType()),
    StructField("platform", StringType()),
    StructField("download_ts", TimestampNTZType()),
])

SIGNUPS = StructType([
    StructField("user_id", LongType()),
    StructField("session_id", StringType()),
    StructField("signup_ts", TimestampNTZType()),
    StructField("age_range", StringType()),
])

RIDE_REQUESTS = StructType([
    StructField("ride_id", LongType()),
    StructField("user_id", LongType()),
    StructField("driver_id", LongType()),
    StructField("request_ts", TimestampNTZType()),
    StructField("dropoff_ts", TimestampNTZType()),
    StructField("cancel_ts", TimestampNTZType()),
])

TRANSACTIONS = StructType([
    StructField("ride_id", LongType()),
    StructField("purchase_amount_usd", DoubleType()),
    StructField("charge_status", StringType()),
])

REVIEWS = StructType([
    StructField("review_id", LongType()),
    StructField("ride_id", LongType()),
    StructField("user_id", LongType()),
    StructField("rating", IntegerType()),
])

TABLE_SCHEMAS = {
    "app_downloads": APP_DOWNLOADS,
    "signups": SIGNUPS,
    "ride_requests": RIDE_REQUESTS,
    "transactions": TRANSACTIONS,
    "reviews": REVIEWS,
}

# Fixed values of the business domain.
PLATFORMS = ["android", "ios", "web"]
AGE_RANGES = ["18-24", "25-34", "35-44", "45-54", "Unknown"]
CHARGE_STATUSES = ["Approved", "Decline"]
FUNNEL_STEPS = {1: "downloads", 2: "signups", 3: "rides_requested", 4: "rides_completed"}
