"""Registered I/O and dashboard-control queries: CSV round trip, shard merge,
drifting and faulty shards, paged export, refresh of a published dataset, filter
domains and slider bounds (by scan or from stored statistics)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelens.functions.exprs import age_sort_key
from ridelens.operators.filters import NO_AGE_BOUND
from ridelens.sources import io, versions

# Column order that makes the per-user daily funnel a total order (the
# non-rider rows at step 3 are unique per age range).
DAILY_USER_ORDER = ["funnel_step", "daily_date", "platform", "age_range", "user_ids"]
PAGE_SIZE = 5000
REFRESH_FROM = dt.date(1995, 4, 1)
# Slider queries: the stored dataset and its columns.
SLIDERS = {
    "slider_bounds": ("driver_rating_summary", ["avg_ratings", "reviews", "rides_completed"]),
    "slider_bounds_user_stats": ("user_ride_stats", ["total_rides", "rides_completed", "rides_canceled"]),
    "slider_bounds_user_declines": ("user_declines", ["lost_total_usd", "gained_total_usd"]),
    "slider_bounds_driver_declines": ("driver_declines", ["lost_total_usd", "gained_total_usd"]),
}


def filter_domains(df: DataFrame, none_option: bool = True) -> DataFrame:
    """Dropdown options of a dataset: ages (non-NULL, not 'Unknown') by lower
    bound, then 'Unknown' and (with `none_option`) the 'None' sentinel;
    platforms alphabetically.

    Rows: domain, value, position.  One scan emits (domain, value) pairs and a
    single distinct reduces them; the numbering window per domain then sees
    only distinct values (a handful), never the dataset's rows."""
    spark = df.sparkSession
    pairs = (df.select(F.inline(F.array(
                F.struct(F.lit("age_range").alias("domain"), F.col("age_range").alias("value")),
                F.struct(F.lit("platform").alias("domain"), F.col("platform").alias("value")))))
             .where(F.col("value").isNotNull()
                    & ~((F.col("domain") == "age_range") & (F.col("value") == "Unknown")))
             .distinct()
             .withColumn("grp", F.lit(0)))
    tail = spark.range(2 if none_option else 1).select(
        F.lit("age_range").alias("domain"),
        F.when(F.col("id") == 0, F.lit("Unknown")).otherwise(F.lit(NO_AGE_BOUND)).alias("value"),
        (F.col("id") + 1).cast("int").alias("grp"))
    w = Window.partitionBy("domain").orderBy(
        "grp", age_sort_key("value").asc_nulls_last(), "value")
    return (pairs.unionByName(tail)
            .select("domain", "value", F.row_number().over(w).cast("int").alias("position")))


def slider_bounds(summary: DataFrame) -> DataFrame:
    """Maximum of each slider's column in the driver summary (one row)."""
    return summary.agg(F.max("avg_ratings").alias("max_avg_ratings"),
                       F.max("reviews").alias("max_reviews"),
                       F.max("rides_completed").alias("max_rides_completed"))


def column_maxima(df: DataFrame, columns: list[str]) -> DataFrame:
    """Maximum of each column as `max_<column>` (one row)."""
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def stored_driver_summary(t, spark: SparkSession) -> DataFrame:
    """Q12 over a stored Q11: the distribution is computed once and read back."""
    from ridelens.operators import drivers
    return drivers.summarise(io.materialize(drivers.driver_rating_distribution(t), "driver_distribution"))


def all_pages(t, spark: SparkSession) -> DataFrame:
    """The whole per-user daily funnel with the page of every row."""
    from ridelens.operators import funnel
    path = io.number_rows(funnel.funnel_daily_user(t), DAILY_USER_ORDER, io.scratch_path(spark, "numbered"))
    return io.read_all_pages(spark, path, PAGE_SIZE)


def page_files(t, spark: SparkSession) -> DataFrame:
    """The per-user daily funnel written as page files and read back with the
    page each row stands in."""
    from ridelens.operators import funnel
    df = funnel.funnel_daily_user(t)
    path = io.export_all_pages(df, io.scratch_path(spark, "pages"), DAILY_USER_ORDER, PAGE_SIZE)
    return io.read_page_files(spark, path, df.schema)


def download_numbers(t, spark: SparkSession) -> DataFrame:
    """A dense number (from 1) for every download, in key order, without a
    single-task window."""
    path = io.number_rows(t.app_downloads.select("app_download_key"), ["app_download_key"],
                          io.scratch_path(spark, "numbered"))
    return spark.read.parquet(path).select("app_download_key", (F.col("_pos") + 1).alias("download_no"))


def csv_roundtrip(df: DataFrame, name: str) -> DataFrame:
    """Write a dataset as header CSV to the shared folder and read it back
    under its own schema."""
    spark = df.sparkSession
    path = io.write_csv(df, io.scratch_path(spark, name))
    return io.read_csv(spark, path, df.schema)


def sharded_roundtrip(df: DataFrame, name: str, rows_per_shard: int) -> DataFrame:
    """Export in shards of at most `rows_per_shard` rows, then merge every
    shard file back with one scan."""
    spark = df.sparkSession
    path = io.write_csv(df, io.scratch_path(spark, name), max_records_per_file=rows_per_shard)
    return io.merge_shards(spark, [f"{path}/part-*.csv"], df.schema)


def drifting_shards(df: DataFrame) -> DataFrame:
    """The per-user daily funnel exported by platform, each with a header of its
    own -- android in another column order, ios without ages, the rest with one
    column more -- and merged by name."""
    spark = df.sparkSession
    root = io.scratch_path(spark, "drift")
    platform = F.col("platform")
    for name, part in {
            "android": df.where(platform == "android").select(*reversed(df.columns)),
            "ios": df.where(platform == "ios").drop("age_range"),
            "rest": df.where(platform.isNull() | ~platform.isin("android", "ios"))
                      .withColumn("shard", F.lit("rest"))}.items():
        io.write_csv(part, f"{root}/{name}")
    return io.merge_by_header(spark, f"{root}/*/part-*.csv", df.schema)


def checked_shards(df: DataFrame) -> DataFrame:
    """Records by outcome after a daily funnel with planted faults is read:
    `outcome` (good or the reason), records, rides.  Of the ios rows the day, of
    the android rows a field is spoilt."""
    spark = df.sparkSession
    path = io.scratch_path(spark, "faults")
    line = F.concat_ws(",", F.col("funnel_step").cast("string"), F.coalesce("platform", F.lit("")),
                       F.when(F.col("platform") == "ios", F.lit("someday"))
                       .otherwise(F.coalesce(F.col("daily_date").cast("string"), F.lit(""))),
                       F.coalesce(F.col("rides").cast("string"), F.lit("")))
    line = F.when(F.col("platform") == "android", F.concat(line, F.lit(",more"))).otherwise(line)
    schema = StructType.fromDDL("funnel_step int, platform string, daily_date date, rides bigint")
    # lines as they are: one column whose name is the header
    df.select(line.alias(",".join(schema.names))).write.csv(path, header=True, sep="\x01")
    good, bad = io.read_csv_checked(spark, path, schema, required=["daily_date"])
    return (good.groupBy(F.lit("good").alias("outcome")).agg(F.count("*").alias("records"), F.sum("rides").alias("rides"))
            .unionByName(bad.groupBy(F.col("reason").alias("outcome")).agg(
                F.count("*").alias("records"), F.lit(None).cast("bigint").alias("rides"))))


def refreshed_daily(t, spark: SparkSession) -> DataFrame:
    """The daily funnel published from the rides requested before a day, then
    refreshed from that day on with all rides."""
    from ridelens.operators import funnel
    from ridelens.sources.tables import RideTables
    asked = F.col("request_ts")
    past = RideTables(t.app_downloads, t.signups,
                      t.ride_requests.where((asked < F.lit(REFRESH_FROM)) | asked.isNull()), t.transactions, t.reviews)
    path = versions.publish(funnel.daily_cells(past), io.scratch_path(spark, "daily"), ["funnel_step"],
                            "daily_date", "quarter")
    versions.refresh(funnel.daily_cells(t), path, REFRESH_FROM)
    return versions.read(spark, path)


def clustered_driver_summary(t, spark: SparkSession) -> DataFrame:
    """Q12 stored in the Z-order of its sliders' columns."""
    from ridelens.operators import drivers
    return spark.read.parquet(io.store_clustered(
        drivers.driver_rating_summary(t), io.scratch_path(spark, "clustered"), SLIDERS["slider_bounds"][1]))


def statistic_maxima(stats: DataFrame, columns: list[str]) -> DataFrame:
    """`column_maxima` of a dataset from its statistics: a row per partition is
    read, none of the dataset."""
    return stats.agg(*[F.max(f"max_{c}").alias(f"max_{c}") for c in columns])


def statistic_domains(stats: DataFrame, none_option: bool = True) -> DataFrame:
    """`filter_domains` of a dataset from its statistics."""
    def values(column, other):
        return stats.select(F.explode(f"values_{column}").alias(column), F.lit(None).cast("string").alias(other))
    return filter_domains(values("age_range", "platform").unionByName(values("platform", "age_range")), none_option)


def exchange_queries(load=None, store=None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered I/O and control queries; `load` as in `panels.panel_queries`."""
    from ridelens.operators import charges, demand, drivers, funnel
    from ridelens.plans.panels import panel_driver_ratings
    from ridelens.sources.adapter import from_driver_tables
    from ridelens.plans.store import SessionStore
    load = load or from_driver_tables
    store = store or SessionStore(load)

    def maxima(name, columns):
        return lambda spark, sf_dir: statistic_maxima(store.statistics(spark, sf_dir, name), columns)

    def run(build):
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(load(spark, sf_dir))
        return q

    return {
        "csv_roundtrip": run(lambda t: csv_roundtrip(funnel.funnel_daily(t), "funnel_daily_csv")),
        "merge_shards": run(lambda t: sharded_roundtrip(funnel.funnel_daily_user(t),
                                                        "funnel_daily_user_shards", 2000)),
        "export_page": run(lambda t: io.export_page(funnel.funnel_daily_user(t), DAILY_USER_ORDER,
                                                    page=1, page_size=PAGE_SIZE)),
        "filter_domains": run(lambda t: filter_domains(funnel.funnel_daily_user(t))),
        "filter_domains_signups": run(lambda t: filter_domains(
            funnel.daily_cells(t).where("funnel_step = 2"), none_option=False)),
        "slider_bounds_user_stats": run(lambda t: column_maxima(
            demand.user_ride_stats(t), ["total_rides", "rides_completed", "rides_canceled"])),
        "slider_bounds_user_declines": run(lambda t: column_maxima(
            charges.decline_cells(t, "user_id"), ["lost_total_usd", "gained_total_usd"])),
        "slider_bounds_driver_declines": run(lambda t: column_maxima(
            charges.decline_cells(t, "driver_id"), ["lost_total_usd", "gained_total_usd"])),
        "export_all_pages": lambda spark, sf_dir: all_pages(load(spark, sf_dir), spark),
        "export_page_files": lambda spark, sf_dir: page_files(load(spark, sf_dir), spark),
        "download_numbers": lambda spark, sf_dir: download_numbers(load(spark, sf_dir), spark),
        "driver_summary_stored": lambda spark, sf_dir: stored_driver_summary(load(spark, sf_dir), spark),
        "panel_driver_ratings_clustered": lambda spark, sf_dir: panel_driver_ratings(
            clustered_driver_summary(load(spark, sf_dir), spark), max_rating=3.0, min_reviews=1, min_completed=1),
        "merge_drifting": run(lambda t: drifting_shards(funnel.funnel_daily_user(t))),
        "csv_rejects": run(lambda t: checked_shards(funnel.daily_cells(t))),
        "funnel_daily_refreshed": lambda spark, sf_dir: refreshed_daily(load(spark, sf_dir), spark),
        **{f"{name}_statistics": maxima(dataset, columns) for name, (dataset, columns) in SLIDERS.items()},
        "filter_domains_statistics": lambda spark, sf_dir: statistic_domains(
            store.statistics(spark, sf_dir, "funnel_daily_user")),
        "filter_domains_signups_statistics": lambda spark, sf_dir: statistic_domains(
            store.statistics(spark, sf_dir, "funnel_daily").where("funnel_step = 2"), none_option=False),
        "slider_bounds": run(lambda t: slider_bounds(drivers.driver_rating_summary(t))),
        "panel_driver_ratings_below_3": run(lambda t: panel_driver_ratings(
            drivers.driver_rating_summary(t), max_rating=3.0, min_reviews=1, min_completed=1)),
    }


def exchange_sql() -> dict[str, tuple[list[tuple[str, str]], str]]:
    daily = [("daily", "funnel_daily")]
    per_user = [("daily_user", "funnel_daily_user")]
    order = ", ".join(f"{c} NULLS LAST" for c in DAILY_USER_ORDER)
    out = {
        "csv_roundtrip": (daily, "SELECT * FROM daily"),
        "merge_shards": (per_user, "SELECT * FROM daily_user"),
        "export_page": (per_user, f"SELECT * FROM daily_user ORDER BY {order} "
                                  f"LIMIT {PAGE_SIZE} OFFSET {PAGE_SIZE}"),
        "filter_domains": (per_user, f"""
WITH ages AS (
  SELECT DISTINCT age_range AS value, 0 AS grp FROM daily_user
  WHERE age_range IS NOT NULL AND age_range <> 'Unknown'
  UNION ALL SELECT 'Unknown', 1
  UNION ALL SELECT '{NO_AGE_BOUND}', 2
)
SELECT 'age_range' AS domain, value,
       CAST(ROW_NUMBER() OVER (ORDER BY grp, TRY_CAST(split_part(value, '-', 1) AS INTEGER) NULLS LAST,
                               value) AS INTEGER) AS position
FROM ages
UNION ALL
SELECT 'platform', value, CAST(ROW_NUMBER() OVER (ORDER BY value) AS INTEGER)
FROM (SELECT DISTINCT platform AS value FROM daily_user WHERE platform IS NOT NULL)"""),
        "filter_domains_signups": (daily, """
SELECT 'age_range' AS domain, value,
       CAST(ROW_NUMBER() OVER (ORDER BY grp, TRY_CAST(split_part(value, '-', 1) AS INTEGER) NULLS LAST,
                               value) AS INTEGER) AS position
FROM (SELECT DISTINCT age_range AS value, 0 AS grp FROM daily
      WHERE funnel_step = 2 AND age_range IS NOT NULL AND age_range <> 'Unknown'
      UNION ALL SELECT 'Unknown', 1)
UNION ALL
SELECT 'platform', value, CAST(ROW_NUMBER() OVER (ORDER BY value) AS INTEGER)
FROM (SELECT DISTINCT platform AS value FROM daily WHERE funnel_step = 2 AND platform IS NOT NULL)"""),
        "slider_bounds_user_stats": ([("stats", "user_ride_stats")], """
SELECT MAX(total_rides) AS max_total_rides, MAX(rides_completed) AS max_rides_completed,
       MAX(rides_canceled) AS max_rides_canceled FROM stats"""),
        **{f"slider_bounds_{who}_declines": ([("points", f"{who}_declines")], """
SELECT MAX(lost_total_usd) AS max_lost_total_usd, MAX(gained_total_usd) AS max_gained_total_usd FROM points""")
           for who in ("user", "driver")},
        "export_all_pages": (per_user, f"""
SELECT *, (ROW_NUMBER() OVER (ORDER BY {order}) - 1) // {PAGE_SIZE} AS page FROM daily_user"""),
        "export_page_files": (per_user, f"""
SELECT *, (ROW_NUMBER() OVER (ORDER BY {order}) - 1) // {PAGE_SIZE} AS page FROM daily_user"""),
        "download_numbers": ([], """
SELECT app_download_key, ROW_NUMBER() OVER (ORDER BY app_download_key) AS download_no FROM app_downloads"""),
        "driver_summary_stored": ([("summary", "driver_rating_summary")], "SELECT * FROM summary"),
        "slider_bounds": ([("summary", "driver_rating_summary")], """
SELECT MAX(avg_ratings) AS max_avg_ratings, MAX(reviews) AS max_reviews,
       MAX(rides_completed) AS max_rides_completed FROM summary"""),
        "panel_driver_ratings_below_3": ([("summary", "driver_rating_summary")], """
SELECT driver_id, avg_ratings, reviews, rides_completed,
       'Driver_id: ' || COALESCE(CAST(driver_id AS VARCHAR), 'nan')
       || '<br>AVG.Rating: ' || COALESCE(CAST(avg_ratings AS VARCHAR), 'nan')
       || '<br>Reviews: ' || COALESCE(CAST(reviews AS VARCHAR), 'nan')
       || '<br>Rides Completed: ' || COALESCE(CAST(rides_completed AS VARCHAR), 'nan') AS label
FROM summary
WHERE avg_ratings >= 0 AND avg_ratings <= 3.0 AND reviews >= 1 AND rides_completed >= 1"""),
    }
    out["funnel_daily_refreshed"] = out["csv_roundtrip"]
    out["panel_driver_ratings_clustered"] = out["panel_driver_ratings_below_3"]
    out["merge_drifting"] = (per_user, """
SELECT * REPLACE (CASE WHEN platform = 'ios' THEN NULL ELSE age_range END AS age_range),
       CASE WHEN platform IS NULL OR platform NOT IN ('android', 'ios') THEN 'rest' END AS shard FROM daily_user""")
    out["csv_rejects"] = (daily, """
SELECT CASE WHEN platform = 'android' THEN 'number of fields' WHEN platform = 'ios' THEN 'daily_date: no date'
            WHEN daily_date IS NULL THEN 'daily_date: missing' ELSE 'good' END AS outcome,
       COUNT(*) AS records,
       CAST(CASE WHEN outcome = 'good' THEN SUM(rides) END AS BIGINT) AS rides
FROM daily GROUP BY outcome""")
    for name in [*SLIDERS, "filter_domains", "filter_domains_signups"]:
        out[f"{name}_statistics"] = out[name]
    return out
