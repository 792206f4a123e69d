"""Mergeable exact distinct users: bitmaps over dense user numbers.

Distinct users are not additive over days, ages or platforms, so a panel that
merges cells of the per-user funnel has to read every user's rows again.  Here
users (and downloads, for step 1) get dense numbers once, and each funnel cell
of one day keeps a bitmap of its users per block of 32,768 numbers.  The
distinct users of any window and merge are then the bits of the OR of stored
cells: `distinct_users` reads no row of a user, and a new day's cells are added
without touching the others.

Numbers follow (platform, age, id), so a segment's users share few blocks.
Cells are dealt by their keys before the bitmaps are built, so no half-filled
bitmaps are shuffled.  Users that are numbered twice do not exist: a number
belongs to one id; an id without a number (null) is in no bitmap, and its cell
keeps a row without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.operators.facts import user_dim
from ridelens.sources import io
from ridelens.sources.tables import RideTables

CELL_KEYS = ["funnel_step", "funnel_name", "platform", "age_range", "daily_date"]


def entities(t: RideTables) -> DataFrame:
    """kind (1 downloads, 2 users), id (as in the per-user funnel), platform and
    age_range of everything that is counted: one row per id."""
    downloads = t.app_downloads.select(F.lit(1).alias("kind"), F.col("app_download_key").alias("id"), "platform",
                                       F.lit(None).cast("string").alias("age_range"))
    users = user_dim(t).select(F.lit(2).alias("kind"), F.col("user_id").cast("string").alias("id"),
                               "platform", "age_range")
    return (downloads.unionByName(users).where(F.col("id").isNotNull())
            .groupBy("kind", "id").agg(F.min("platform").alias("platform"), F.min("age_range").alias("age_range")))


def write_numbers(t: RideTables, path: str, num_partitions: int | None = None) -> str:
    """Store kind, id and the dense number `_pos` (from 0 over both kinds)."""
    return io.number_rows(entities(t), ["kind", "platform", "age_range", "id"], path, num_partitions)


def extend_numbers(t: RideTables, path: str, num_partitions: int | None = None) -> None:
    """Give numbers to the users and downloads that have none yet, above all
    given ones: earlier numbers, and so the stored bitmaps, stay as they are."""
    spark = t.signups.sparkSession
    given = spark.read.parquet(path)
    new = entities(t).join(given.select("kind", "id"), ["kind", "id"], "left_anti")
    added = io.scratch_path(spark, "numbered")
    io.number_rows(new, ["kind", "platform", "age_range", "id"], added, num_partitions)
    first = (given.agg(F.max("_pos")).first()[0] + 1) if not given.isEmpty() else 0
    (spark.read.parquet(added).withColumn("_pos", F.col("_pos") + first).select(*given.columns)
     .write.mode("append").parquet(path))
    io.drop_scratch(spark, added)


def user_cells(daily_user: DataFrame, numbers: DataFrame) -> DataFrame:
    """CELL_KEYS, block, bitmap and rides from the per-user daily funnel."""
    kind = F.when(F.col("funnel_step") == 1, 1).otherwise(2)
    known = numbers.select("kind", F.col("id").alias("user_ids"), (F.col("_pos") + 1).alias("number"))
    rows = daily_user.withColumn("kind", kind).join(known, ["kind", "user_ids"], "left").select(
        *CELL_KEYS, F.bitmap_bucket_number("number").alias("block"),
        F.bitmap_bit_position("number").alias("bit"), "rides")
    # a cell and block have at most 32,768 users, whoever rides most
    parts = int(daily_user.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, *CELL_KEYS, "block").groupBy(*CELL_KEYS, "block")
            .agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.sum("rides").cast("bigint").alias("rides"))
            .withColumn("bitmap", F.when(F.col("block").isNotNull(), F.col("bitmap"))))


def distinct_users(cells: DataFrame, keys: list[str], rides: bool = False) -> DataFrame:
    """`keys`, users [and rides] of stored cells: the OR of each block's
    bitmaps, then the number of bits."""
    total: list[Column] = [F.sum("rides").cast("bigint").alias("rides")] if rides else []
    blocks = cells.groupBy(*keys, "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), *total)
    bits = F.when(F.col("block").isNotNull(), F.bitmap_count("bitmap")).otherwise(0)
    return blocks.groupBy(*keys).agg(F.sum(bits).alias("users"), *total)
