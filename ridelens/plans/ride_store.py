"""Ride cells: the ride-keyed tables joined and reduced once, for all queries.

Every funnel, charge, decline, driver and review query joins ride requests with
their transactions and reviews.  `write_ride_cells` does it once and stores

==============  ================================================  =============
rides           one row per ride: its columns, the counts and     bucketed by
                sums of its charges and reviews                   ride_id
charges         one row per ride and charge status                bucketed by
                                                                  ride_id
reviews         one row per ride, reviewer and rating             bucketed by
                                                                  ride_id
lost_reviews    one row per reviewer and rating of the reviews    plain
                without a ride id
==============  ================================================  =============

With `RideTables.with_cells` the operators read these instead: most need the
rides alone, and what still meets by ride (charge status x reviewer, rating x
usd) joins the bucketed cells without an exchange.  Everything is reduced per
ride before it is bucketed, so a bucket holds about the same number of rides;
rows without a ride id, which would all share one bucket, stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.operators.facts import TOTAL, ride_charges, ride_facts, ride_reviews
from ridelens.sources.buckets import open_bucketed, write_bucketed
from ridelens.sources.tables import RideTables

BUCKETED = ("rides", "charges", "reviews")


def cell_frames(t: RideTables) -> dict[str, DataFrame]:
    """The frames of the four datasets, from the raw tables."""
    reviews = ride_reviews(t)

    def counted(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n_reviews").alias("n_reviews"), F.sum("n_review_ids").alias("n_review_ids"))
    return {
        "rides": ride_facts(t),
        "charges": (ride_charges(t).where(F.col("ride_id").isNotNull()).groupBy("ride_id", "charge_status")
                    .agg(F.sum("n_charges").alias("n_charges"), F.sum("usd").cast(TOTAL).alias("usd"))),
        "reviews": counted(reviews.where(F.col("ride_id").isNotNull()), "ride_id", "reviewer_id", "rating"),
        "lost_reviews": counted(reviews.where(F.col("ride_id").isNull()), "reviewer_id", "rating"),
    }


def write_ride_cells(t: RideTables, root: str, buckets: int | None = None) -> str:
    for name, df in cell_frames(t).items():
        if name in BUCKETED:
            write_bucketed(df, f"{root}/{name}", "ride_id", buckets)
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")
    return root


def read_ride_cells(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {**{name: open_bucketed(spark, f"{root}/{name}") for name in BUCKETED},
            "lost_reviews": spark.read.parquet(f"{root}/lost_reviews")}
