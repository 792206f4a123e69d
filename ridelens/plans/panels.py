"""The parameterised datasets behind the dashboard (one function per chart).

Each panel is "dataset -> filters -> aggregate -> reshape" as one lazy plan.
Inputs are the stored results of the daily funnel (`funnel_daily`, Q03), the
per-user daily funnel (`funnel_daily_user`, Q04) and the summary queries.
When those are read from a store (`plans.store`, partitioned by funnel step)
the step and date predicates prune partitions and push into the Parquet
scan; only chart-sized rows (days x platforms at most) come out.

Parameters mirror the dashboard controls; the defaults are its defaults
except the date window, which is open (None) instead of a calendar range
tied to one data set.  "merge" drops a dimension before aggregating; distinct
users are always recounted, from per-user rows or as the OR of stored bitmaps,
never added across segments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelens.functions.exprs import mean_of_means
from ridelens.operators.filters import (NO_AGE_BOUND, age_between_null_tolerant,
                                        age_between_unless_unset, at_least, at_most,
                                        date_between, text_between)
from ridelens.operators.reshape import (dense_grid, histogram, pivot_wide, relabel_steps,
                                        segment_label, to_long)
from ridelens.operators.user_bitmaps import distinct_users
from ridelens.sources.schemas import PLATFORMS

# Dashboard defaults (fixed values).
FIRST_PLATFORM, LAST_PLATFORM = "android", "web"
FIRST_AGE, LAST_AGE = "18-24", "Unknown"
# How the dashboard's hover text shows a missing number (fixed value).
MISSING = "nan"


def _sorted(df: DataFrame, *cols: str) -> DataFrame:
    """Chart order (x axis, then series).  Panels are chart-sized -- at most
    days x platforms x series rows -- so this final sort is cheap."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def _step_filter(df: DataFrame, step: int, start_date, end_date, start_platform, end_platform,
                 start_age=None, end_age=None) -> DataFrame:
    cond = ((F.col("funnel_step") == step)
            & date_between("daily_date", start_date, end_date)
            & text_between("platform", start_platform, end_platform))
    if start_age is not None or end_age is not None:
        cond = cond & text_between("age_range", start_age, end_age)
    return df.where(cond)


def _with_pct_initial(df: DataFrame, value: str) -> DataFrame:
    """value / value of the first step shown, per platform (funnel chart)."""
    w = Window.partitionBy("platform").orderBy("funnel_step")
    first = F.first(F.nullif(F.col(value), F.lit(0))).over(w)
    return df.withColumn("pct_initial", F.col(value).cast("double") / first.cast("double"))


def _users_by(f: DataFrame, keys: list[str], rides: bool = False) -> DataFrame:
    """Distinct users [and rides] by `keys`: from per-user rows, or from the
    stored bitmaps of `operators.user_bitmaps`."""
    if "bitmap" in f.columns:
        return distinct_users(f, keys, rides)
    return f.groupBy(*keys).agg(F.count_distinct("user_ids").alias("users"),
                                *([F.sum("rides").cast("bigint").alias("rides")] if rides else []))


# -- funnels from the per-user dataset -------------------------------------------

def panel_user_funnel(daily_user: DataFrame, start_date=None, end_date=None,
                      start_age: str = NO_AGE_BOUND, end_age: str = LAST_AGE,
                      start_platform: str = FIRST_PLATFORM, end_platform: str = LAST_PLATFORM) -> DataFrame:
    """Distinct users per step x platform with percent of the first step.
    With both age bounds set, downloads (no age) drop out and the funnel
    starts at signups."""
    f = daily_user.where(age_between_unless_unset("age_range", start_age, end_age)
                         & date_between("daily_date", start_date, end_date)
                         & text_between("platform", start_platform, end_platform))
    cells = _users_by(f, ["funnel_step", "funnel_name", "platform"])
    return _sorted(_with_pct_initial(cells, "users").withColumn("funnel_label", relabel_steps()),
                   "funnel_step", "platform")


def panel_user_funnel_pivot(daily_user: DataFrame, platforms: list[str] = PLATFORMS, **params) -> DataFrame:
    """D01 as the chart's matrix: one row per step with its display name, one
    column per platform of `platforms` and one for all others."""
    return _sorted(pivot_wide(panel_user_funnel(daily_user, **params), ["funnel_step", "funnel_label"], "platform",
                              platforms, "users"), "funnel_step")


def panel_rides_funnel_pivot(daily_user: DataFrame, platforms: list[str] = PLATFORMS, **params) -> DataFrame:
    """D02 as the chart's matrix of rides."""
    return _sorted(pivot_wide(panel_rides_funnel(daily_user, **params), ["funnel_step", "funnel_label"], "platform",
                              platforms, "rides"), "funnel_step")


def panel_rides_funnel(daily_user: DataFrame, start_date=None, end_date=None,
                       start_age: str = FIRST_AGE, end_age: str = LAST_AGE,
                       start_platform: str = FIRST_PLATFORM, end_platform: str = LAST_PLATFORM) -> DataFrame:
    """Steps 3-4, distinct users and rides per step x platform, percent
    of step 3 rides (null-tolerant age filter)."""
    f = daily_user.where(F.col("funnel_step").isin(3, 4)
                         & date_between("daily_date", start_date, end_date)
                         & age_between_null_tolerant("age_range", start_age, end_age)
                         & text_between("platform", start_platform, end_platform))
    cells = _users_by(f, ["funnel_step", "funnel_name", "platform"], rides=True)
    return _sorted(_with_pct_initial(cells, "rides").withColumn("funnel_label", relabel_steps()),
                   "funnel_step", "platform")


# -- segment bars (age x platform, or platform when ages are merged) -------------

def _segment_bars(df: DataFrame, step: int, measure, fill, params: dict, merge_ages: bool) -> DataFrame:
    f = _step_filter(df, step, **params)
    if merge_ages:
        return _sorted(f.groupBy("platform").agg(measure), "platform")
    return _segment_grid(f.groupBy("age_range", "platform").agg(measure), fill)


def _segment_grid(cells: DataFrame, fill) -> DataFrame:
    name = cells.columns[-1]
    grid = (dense_grid(cells, "age_range", "platform", {name: fill} if fill is not None else {})
            .withColumn("label", segment_label("age_range", "platform")))
    return _sorted(grid, "age_range", "platform")


def _params(start_date, end_date, start_age, end_age, start_platform, end_platform) -> dict:
    return dict(start_date=start_date, end_date=end_date, start_age=start_age, end_age=end_age,
                start_platform=start_platform, end_platform=end_platform)


def panel_signups(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                  end_age=LAST_AGE, start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                  merge_ages: bool = False) -> DataFrame:
    """Signups per age x platform (dense, 0 when empty) or per platform."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _segment_bars(daily, 2, F.sum("users").cast("bigint").alias("users"), 0, p, merge_ages)


def _distinct_users_bars(daily_user: DataFrame, step: int, p: dict, merge_ages: bool) -> DataFrame:
    f = _step_filter(daily_user, step, **p)
    if merge_ages:
        return _sorted(_users_by(f, ["platform"], rides=True), "platform")
    return _segment_grid(_users_by(f, ["age_range", "platform"]), 0)


def panel_requesting_users(daily_user: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                           end_age=LAST_AGE, start_platform=FIRST_PLATFORM,
                           end_platform=LAST_PLATFORM, merge_ages: bool = False) -> DataFrame:
    """Distinct requesting users per age x platform, or per platform with rides."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _distinct_users_bars(daily_user, 3, p, merge_ages)


def panel_completing_users(daily_user: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                           end_age=LAST_AGE, start_platform=FIRST_PLATFORM,
                           end_platform=LAST_PLATFORM, merge_ages: bool = False) -> DataFrame:
    """As D06 for completed rides."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _distinct_users_bars(daily_user, 4, p, merge_ages)


def panel_rides_requested(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                          end_age=LAST_AGE, start_platform=FIRST_PLATFORM,
                          end_platform=LAST_PLATFORM, merge_ages: bool = False) -> DataFrame:
    """Requested rides per age x platform (dense) or per platform."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _segment_bars(daily, 3, F.sum("rides").cast("bigint").alias("rides"), 0, p, merge_ages)


def panel_rides_completed(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                          end_age=LAST_AGE, start_platform=FIRST_PLATFORM,
                          end_platform=LAST_PLATFORM, merge_ages: bool = False) -> DataFrame:
    """Completed rides per age x platform (dense) or per platform."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _segment_bars(daily, 4, F.sum("rides").cast("bigint").alias("rides"), 0, p, merge_ages)


def panel_usd(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
              end_age=LAST_AGE, start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
              merge_ages: bool = False) -> DataFrame:
    """Usd of completed rides per age x platform (dense) or per platform."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _segment_bars(daily, 4, F.sum("total_usd").cast("bigint").alias("total_usd"), 0, p,
                         merge_ages)


def panel_avg_rating(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                     end_age=LAST_AGE, start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                     merge_ages: bool = False) -> DataFrame:
    """Unweighted mean of the daily mean ratings, 2 decimals; NULL for an
    empty segment.  (Rounds HALF_UP; the notebook's pandas rounds half-even.)"""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _segment_bars(daily, 4, mean_of_means("avg_rating", 2).alias("avg_rating"), None, p,
                         merge_ages)


# -- daily lines (day x platform, or day when platforms are merged) --------------

def _daily_lines(daily: DataFrame, step: int, p: dict, merge_platforms: bool,
                 measures: list, labels: dict[str, str] | None) -> DataFrame:
    f = _step_filter(daily, step, p["start_date"], p["end_date"], p["start_platform"],
                     p["end_platform"], p["start_age"], p["end_age"])
    keys = ["daily_date"] if merge_platforms else ["daily_date", "platform"]
    out = f.groupBy(*keys).agg(*measures)
    if labels:
        return _sorted(to_long(out, keys, labels), *keys, "measure")
    return _sorted(out, *keys)


def panel_daily_downloads(daily: DataFrame, start_date=None, end_date=None,
                          start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                          merge_platforms: bool = False) -> DataFrame:
    """Downloads per day (x platform).  Downloads have no age filter."""
    p = _params(start_date, end_date, None, None, start_platform, end_platform)
    return _daily_lines(daily, 1, p, merge_platforms,
                        [F.sum("users").cast("bigint").alias("users")], None)


def panel_daily_signups(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                        end_age=LAST_AGE, start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                        merge_platforms: bool = False) -> DataFrame:
    """Signups per day (x platform)."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _daily_lines(daily, 2, p, merge_platforms,
                        [F.sum("users").cast("bigint").alias("users")], None)


def panel_daily_rides_cancellations(daily: DataFrame, start_date=None, end_date=None,
                                    start_age=FIRST_AGE, end_age=LAST_AGE,
                                    start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                                    merge_platforms: bool = False) -> DataFrame:
    """Requested rides and cancellations per day (x platform), long form."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _daily_lines(daily, 3, p, merge_platforms,
                        [F.sum("rides").alias("rides"), F.sum("cancellations").alias("cancellations")],
                        {"rides": "Rides", "cancellations": "Cancellations"})


def panel_daily_rides_usd(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                          end_age=LAST_AGE, start_platform=FIRST_PLATFORM, end_platform=LAST_PLATFORM,
                          merge_platforms: bool = False) -> DataFrame:
    """Completed rides and usd per day (x platform), long form."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _daily_lines(daily, 4, p, merge_platforms,
                        [F.sum("rides").alias("rides"), F.sum("total_usd").alias("total_usd")],
                        {"rides": "Rides", "total_usd": "USD"})


def panel_daily_reviews_rating(daily: DataFrame, start_date=None, end_date=None, start_age=FIRST_AGE,
                               end_age=LAST_AGE, start_platform=FIRST_PLATFORM,
                               end_platform=LAST_PLATFORM, merge_platforms: bool = False) -> DataFrame:
    """Reviews (sum) and mean rating (mean of cell means, 10 decimals) per
    day, long form."""
    p = _params(start_date, end_date, start_age, end_age, start_platform, end_platform)
    return _daily_lines(daily, 4, p, merge_platforms,
                        [F.sum("total_reviews").alias("total_reviews"),
                         mean_of_means("avg_rating", 10).alias("avg_rating")],
                        {"total_reviews": "Reviews", "avg_rating": "Rating"})


# -- panels over the summary queries ----------------------------------------------

def panel_requests_by_hour(hourly: DataFrame) -> DataFrame:
    """Hour, request count."""
    return hourly.select("request_hour", "num_requests")


def panel_rides_histogram(rides_per_user: DataFrame, width: int = 5, bins: int = 12) -> DataFrame:
    """Users per bucket of `width` rides; users beyond the last bucket are
    counted in an open one."""
    return _sorted(histogram(rides_per_user, "rides", "user_id", width, bins), "bin_start")


def panel_driver_ratings(summary: DataFrame, min_rating: float = 0.0, max_rating: float = 2.5,
                         min_reviews: float = 17, min_completed: float = 21) -> DataFrame:
    """Drivers inside the rating / reviews / completed-rides thresholds."""
    f = summary.where(at_least(avg_ratings=min_rating, reviews=min_reviews,
                               rides_completed=min_completed)
                      & at_most(avg_ratings=max_rating))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
             for c in ("driver_id", "avg_ratings", "reviews", "rides_completed")]
    label = F.format_string("Driver_id: %s<br>AVG.Rating: %s<br>Reviews: %s<br>Rides Completed: %s",
                            *shown)
    return f.select("driver_id", "avg_ratings", "reviews", "rides_completed", label.alias("label"))


def panel_user_types(stats: DataFrame, min_canceled: float = 0, min_completed: float = 0,
                     min_total: float = 0) -> DataFrame:
    """Users typed Full Cancellations / Full Completed Rides / Mixed."""
    user_type = (F.when((F.col("rides_completed") == 0) & (F.col("rides_canceled") > 0),
                        F.lit("Full Cancellations"))
                 .when((F.col("rides_completed") > 0) & (F.col("rides_canceled") == 0),
                       F.lit("Full Completed Rides"))
                 .otherwise(F.lit("Mixed")))
    f = stats.where(at_least(rides_canceled=min_canceled, rides_completed=min_completed,
                             total_rides=min_total))
    label = F.concat(user_type, F.lit("<br>Rides Canceled: "), F.col("rides_canceled").cast("string"),
                     F.lit("<br>Rides Completed: "), F.col("rides_completed").cast("string"))
    return f.select("user_id", "total_rides", "rides_completed", "rides_canceled",
                    user_type.alias("user_type"), label.alias("label"))


def panel_charge_users_drivers(charge_stats: DataFrame) -> DataFrame:
    """Per charge status, users and drivers as two bars."""
    return to_long(charge_stats, ["charge_status"], {"users": "Users", "drivers": "Drivers"})


def panel_charge_rides_reviews(charge_stats: DataFrame) -> DataFrame:
    """Per charge status, rides and reviews as two bars."""
    return to_long(charge_stats, ["charge_status"], {"rides": "Rides", "reviews": "Reviews"})


def panel_charge_usd(charge_stats: DataFrame) -> DataFrame:
    """Usd per charge status."""
    return charge_stats.select("charge_status", "total_usd")


def _usd_points(declines: DataFrame, key: str, min_lost: float, min_gained: float) -> DataFrame:
    f = declines.where(at_least(lost_total_usd=min_lost, gained_total_usd=min_gained))
    return to_long(f, [key], {"lost_total_usd": "Lost Total USD",
                              "gained_total_usd": "Gained Total USD"})


def panel_usd_by_user(user_declines: DataFrame, min_lost: float = 0, min_gained: float = 0) -> DataFrame:
    """Lost and gained usd per user with repeated declines."""
    return _usd_points(user_declines, "user_id", min_lost, min_gained)


def panel_usd_by_driver(driver_declines: DataFrame, min_lost: float = 0,
                        min_gained: float = 0) -> DataFrame:
    """Lost and gained usd per driver with repeated declines."""
    return _usd_points(driver_declines, "driver_id", min_lost, min_gained)


# -- registry hook --------------------------------------------------------------------

# Panels are registered with the open window; these parameters belong to the
# extra keys that exercise the filters (each removes rows of the test tables).
WINDOW = {"start_date": "1994-02-01", "end_date": "1995-06-30"}
AGES = {"start_age": "25-34", "end_age": "35-44"}
IOS = {"start_platform": "ios", "end_platform": "ios"}
USER_TYPE_BOUNDS = {"min_canceled": 2, "min_completed": 1, "min_total": 4}
USD_BOUNDS = {"min_lost": 100000, "min_gained": 200000}


def panel_queries(load=None, store=None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered panels; `load(spark, sf_dir) -> RideTables` supplies the
    tables (default: the fixture mapping of the driver's test data).  As the
    dashboard does, they read the datasets of a store (`SessionStore`), which is
    written when the first of them asks for one; the `*_raw` keys compute theirs
    from the tables instead, and the `*_stored` ones write a store of their own."""
    from ridelens.operators import funnel
    from ridelens.plans.store import SessionStore
    from ridelens.sources.adapter import from_driver_tables
    load = load or from_driver_tables
    store = store or SessionStore(load)

    def stored_over(name, panel, **params):
        """The panel over its dataset in a store written first: the step prunes
        partitions and the dates row groups."""
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ridelens.plans.store import read_store, write_store
            from ridelens.sources.io import scratch_path
            root = scratch_path(spark, "store")
            write_store(load(spark, sf_dir), root, [name])
            return panel(read_store(spark, root, [name])[name], **params)
        run.__doc__ = panel.__doc__
        return run

    def over_raw(source, panel, **params):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return panel(source(load(spark, sf_dir)), **params)
        run.__doc__ = panel.__doc__
        return run

    def over(name, panel, **params):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return panel(store.dataset(spark, sf_dir, name), **params)
        run.__doc__ = panel.__doc__
        return run

    daily, per_user = "funnel_daily", "funnel_daily_user"
    return {
        "panel_user_funnel": over(per_user, panel_user_funnel),
        "panel_user_funnel_pivot": over(per_user, panel_user_funnel_pivot),
        "panel_rides_funnel": over(per_user, panel_rides_funnel),
        "panel_user_funnel_raw": over_raw(funnel.funnel_daily_user, panel_user_funnel),
        "panel_signups_raw": over_raw(funnel.daily_cells, panel_signups),
        "panel_daily_downloads": over(daily, panel_daily_downloads),
        "panel_signups": over(daily, panel_signups),
        "panel_signups_merged": over(daily, panel_signups, merge_ages=True),
        "panel_daily_signups": over(daily, panel_daily_signups),
        "panel_requesting_users": over(per_user, panel_requesting_users),
        "panel_requesting_users_merged": over(per_user, panel_requesting_users, merge_ages=True),
        "panel_rides_requested": over(daily, panel_rides_requested),
        "panel_daily_rides_cancellations": over(daily, panel_daily_rides_cancellations),
        "panel_daily_rides_cancellations_merged": over(daily, panel_daily_rides_cancellations,
                                                       merge_platforms=True),
        "panel_requests_by_hour": over("requests_by_hour", panel_requests_by_hour),
        "panel_rides_histogram": over("rides_per_user", panel_rides_histogram),
        "panel_completing_users": over(per_user, panel_completing_users),
        "panel_rides_completed": over(daily, panel_rides_completed),
        "panel_usd": over(daily, panel_usd),
        "panel_daily_rides_usd": over(daily, panel_daily_rides_usd),
        "panel_avg_rating": over(daily, panel_avg_rating),
        "panel_avg_rating_merged": over(daily, panel_avg_rating, merge_ages=True),
        "panel_driver_ratings": over("driver_rating_summary", panel_driver_ratings),
        "panel_daily_reviews_rating": over(daily, panel_daily_reviews_rating),
        "panel_user_types": over("user_ride_stats", panel_user_types),
        "panel_charge_users_drivers": over("charge_status_stats", panel_charge_users_drivers),
        "panel_charge_rides_reviews": over("charge_status_stats", panel_charge_rides_reviews),
        "panel_charge_usd": over("charge_status_stats", panel_charge_usd),
        "panel_daily_downloads_merged": over(daily, panel_daily_downloads, merge_platforms=True),
        "panel_daily_signups_merged": over(daily, panel_daily_signups, merge_platforms=True),
        "panel_rides_requested_merged": over(daily, panel_rides_requested, merge_ages=True),
        "panel_completing_users_merged": over(per_user, panel_completing_users, merge_ages=True),
        "panel_rides_completed_merged": over(daily, panel_rides_completed, merge_ages=True),
        "panel_usd_merged": over(daily, panel_usd, merge_ages=True),
        "panel_daily_rides_usd_merged": over(daily, panel_daily_rides_usd, merge_platforms=True),
        "panel_daily_reviews_rating_merged": over(daily, panel_daily_reviews_rating, merge_platforms=True),
        "panel_signups_stored": stored_over("funnel_daily", panel_signups),
        "panel_daily_rides_usd_stored": stored_over("funnel_daily", panel_daily_rides_usd),
        "panel_user_funnel_stored": stored_over("funnel_daily_user", panel_user_funnel),
        "panel_rides_funnel_pivot": over(per_user, panel_rides_funnel_pivot),
        "panel_rides_requested_window": over(daily, panel_rides_requested, **WINDOW),
        "panel_user_funnel_ages": over(per_user, panel_user_funnel, **AGES),
        "panel_signups_ios": over(daily, panel_signups, **IOS),
        "panel_user_types_bounded": over("user_ride_stats", panel_user_types, **USER_TYPE_BOUNDS),
        "panel_usd_by_user_bounded": over("user_declines", panel_usd_by_user,
                                          **USD_BOUNDS),
        "panel_usd_by_driver_bounded": over("driver_declines", panel_usd_by_driver, **USD_BOUNDS),
        "panel_usd_by_user": over("user_declines", panel_usd_by_user),
        "panel_usd_by_driver": over("driver_declines", panel_usd_by_driver),
    }
