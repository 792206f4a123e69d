"""The four-step conversion funnel at four grains.

Steps: 1 downloads, 2 signups, 3 rides requested, 4 rides completed (dropped
off *and* charge Approved).  One builder serves every grain:

=============  ====================================  =========================
grain          group keys                            users column
=============  ====================================  =========================
platform       platform                              distinct users (BIGINT)
age_platform   age_range, platform                   distinct users (BIGINT)
daily          age_range, platform, daily_date       distinct users (BIGINT)
daily_user     age_range, platform, daily_date, id   ``user_ids`` (STRING)
=============  ====================================  =========================

Semantics kept on purpose:
* downloads carry no age, so at age grains step 1 has one row per platform
  with NULL age plus one empty row per signup age (users NULL, platform NULL);
  at platform grain there is one such empty row;
* signups that never rode form a step-3 row with NULL platform (users 0);
* step 3 counts every request, step 4 only dropped-off, Approved rides;
* ``total_usd`` is rounded to whole dollars per output cell;
* the daily grain counts downloads with COUNT, not COUNT DISTINCT, and dates
  are the day of download / signup / request / drop-off by step;
* at the per-user grain ``user_ids`` is the download key at step 1 and the
  user id (as text) afterwards; non-riders collapse to one NULL-id row per
  age at step 3.

Plan shape: ride facts are reduced to (user[, day]) cells by a hash
aggregate (map-side partial aggregation) before they meet the user
dimension, so every join after the ride-keyed one is user-sized and a hot
user never lands whole in one task.  Distinct users are counted from those
cells, never added up across days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions.exprs import day, ratio, round_half_up_ratio, usd
from ridelens.operators.facts import TOTAL, times, user_dim
from ridelens.sources.schemas import FUNNEL_STEPS
from ridelens.sources.tables import RideTables


@dataclass(frozen=True)
class Grain:
    name: str
    age: bool
    daily: bool
    per_user: bool


GRAINS = {
    "platform": Grain("platform", age=False, daily=False, per_user=False),
    "age_platform": Grain("age_platform", age=True, daily=False, per_user=False),
    "daily": Grain("daily", age=True, daily=True, per_user=False),
    "daily_user": Grain("daily_user", age=True, daily=True, per_user=True),
}


def _null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def _columns(g: Grain) -> list[str]:
    cols = ["funnel_step", "funnel_name", "user_ids" if g.per_user else "users", "platform"]
    if g.age:
        cols.append("age_range")
    cols += ["total_usd", "rides", "cancellations", "total_reviews", "avg_rating"]
    if g.daily:
        cols.append("daily_date")
    return cols


def _finish(df: DataFrame, step: int, g: Grain) -> DataFrame:
    """Add the step constants and typed NULL placeholders in one projection."""
    defaults = {"total_usd": "bigint", "rides": "bigint", "cancellations": "bigint",
                "total_reviews": "bigint", "avg_rating": "double", "age_range": "string",
                "daily_date": "date", "users": "bigint", "user_ids": "string"}
    consts = {"funnel_step": F.lit(step), "funnel_name": F.lit(FUNNEL_STEPS[step])}
    present = set(df.columns)
    return df.select(*[
        consts[c].alias(c) if c in consts
        else F.col(c) if c in present
        else _null(defaults[c]).alias(c)
        for c in _columns(g)])


def _keys(g: Grain, date_col: str | None = None, id_col: str | None = None,
          with_age: bool = True) -> list[Column]:
    keys = []
    if g.age and with_age:
        keys.append(F.col("age_range"))
    keys.append(F.col("platform"))
    if g.daily and date_col:
        keys.append(day(date_col).alias("daily_date"))
    if g.per_user and id_col:
        keys.append(F.col(id_col).cast("string").alias("user_ids"))
    return keys


def _downloads(t: RideTables, g: Grain) -> DataFrame:
    ad = t.app_downloads
    if g.per_user:
        cells = ad.select(*_keys(g, "download_ts", "app_download_key", with_age=False)).distinct()
        return _finish(cells, 1, g)
    if g.daily:
        cells = (ad.groupBy(*_keys(g, "download_ts", with_age=False))
                 .agg(F.count("app_download_key").alias("users")))
        return _finish(cells, 1, g)
    per_platform = ad.groupBy("platform").agg(
        F.count_distinct("app_download_key").alias("users"))
    # The age (or nothing) of every signup, with no count: one empty row per
    # distinct value, exactly what a set UNION of per-signup rows leaves.
    fillers = t.signups.select(
        *([F.col("age_range")] if g.age else []),
        _null("bigint").alias("users"), _null("string").alias("platform")).distinct()
    return _finish(per_platform, 1, g).unionByName(_finish(fillers, 1, g))


def _signups(users: DataFrame, g: Grain) -> DataFrame:
    if g.per_user:
        return _finish(users.select(*_keys(g, "signup_ts", "user_id")).distinct(), 2, g)
    cells = users.groupBy(*_keys(g, "signup_ts")).agg(
        F.count_distinct("user_id").alias("users"))
    return _finish(cells, 2, g)


def _completed(t: RideTables, day4: list[Column]) -> DataFrame:
    """Step-4 cells per rider [and day]: dropped-off rides with an Approved
    charge, once per charge and review.  Stored rides carry the sums of both, so
    nothing is joined."""
    if t.cells:
        joined = F.col("n_approved") * F.col("per_review")
        return (t.cells["rides"].where(F.col("dropoff_ts").isNotNull() & (F.col("n_approved") > 0))
                .groupBy(F.col("user_id").alias("rider_id"), *day4)
                .agg(F.lit(4).alias("step"),
                     F.sum(joined).alias("n_rides"),
                     F.sum(F.when(F.col("cancel_ts").isNotNull(), joined).otherwise(0)).alias("n_cancels"),
                     F.sum(times("approved_usd", "per_review")).cast(TOTAL).alias("usd"),
                     F.sum(F.coalesce("n_review_ids", F.lit(0))).alias("n_reviews"),
                     F.sum(F.col("rating_sum") * F.col("n_approved")).alias("rating_sum"),
                     F.sum(F.coalesce("rating_n", F.lit(0)) * F.col("n_approved")).alias("rating_n")))
    rides = (t.ride_requests.where(F.col("dropoff_ts").isNotNull())
             .select("ride_id", "user_id", "dropoff_ts", "cancel_ts"))
    approved = (t.transactions.where(F.col("charge_status") == "Approved")
                .select("ride_id", usd("purchase_amount_usd").alias("usd")))
    reviews = t.reviews.select("ride_id", "review_id", "rating")
    return (rides.join(approved, "ride_id").join(reviews, "ride_id", "left")
            .groupBy(F.col("user_id").alias("rider_id"), *day4)
            .agg(F.lit(4).alias("step"),
                 F.count("ride_id").alias("n_rides"),
                 F.count("cancel_ts").alias("n_cancels"),
                 F.sum("usd").cast(TOTAL).alias("usd"),
                 F.count_distinct("review_id").alias("n_reviews"),
                 F.sum("rating").cast("bigint").alias("rating_sum"),
                 F.count("rating").alias("rating_n")))


def _ride_steps(t: RideTables, users: DataFrame, g: Grain) -> DataFrame:
    """Steps 3 and 4 from one join with the user dimension.

    Rides are reduced to cells per (user[, day]) twice -- every request for
    step 3 (day = request day), dropped-off Approved rides with their reviews
    for step 4 (day = drop-off day) -- and the two cell sets are unioned with
    a step tag.  Both aggregates are hash-partitioned on the user, which the
    union keeps, so the user dimension is joined once and only it shuffles
    (at daily grains the cells are keyed by user and day, so the union is
    re-partitioned by user).  One aggregation then yields both steps.  A signup that never rode matches
    no cell and becomes the NULL-platform step-3 row."""
    day3 = [day("request_ts").alias("daily_date")] if g.daily else []
    requested = (t.ride_requests.groupBy(F.col("user_id").alias("rider_id"), *day3)
                 .agg(F.lit(3).alias("step"),
                      F.count("ride_id").alias("n_rides"),
                      F.count("cancel_ts").alias("n_cancels"),
                      _null(TOTAL).alias("usd"),
                      _null("bigint").alias("n_reviews"),
                      _null("bigint").alias("rating_sum"),
                      _null("bigint").alias("rating_n")))

    completed = _completed(t, [day("dropoff_ts").alias("daily_date")] if g.daily else [])
    joined = (users.select("user_id", "age_range", "platform")
              .join(requested.unionByName(completed), F.col("user_id") == F.col("rider_id"), "left"))

    rider = F.col("rider_id")
    step = F.coalesce(F.col("step"), F.lit(3))
    keys = [step.alias("funnel_step")]
    if g.age:
        keys.append(F.col("age_range"))
    # a signup that never rode has no platform at step 3
    keys.append(F.when(rider.isNotNull(), F.col("platform")).alias("platform"))
    if g.daily:
        keys.append(F.col("daily_date"))
    if g.per_user:
        keys.append(rider.cast("string").alias("user_ids"))
    measures = [F.round(F.sum("usd"), 0).cast("bigint").alias("total_usd"),
                F.coalesce(F.sum("n_rides"), F.lit(0)).alias("rides"),
                F.coalesce(F.sum("n_cancels"), F.lit(0)).alias("cancellations"),
                F.sum("n_reviews").alias("total_reviews"),
                ratio(F.sum("rating_sum"), F.sum("rating_n")).alias("avg_rating")]
    if not g.per_user:
        measures.insert(0, F.count(rider).alias("users"))
    out = joined.groupBy(*keys).agg(*measures)
    name = F.when(F.col("funnel_step") == 3, F.lit(FUNNEL_STEPS[3])).otherwise(F.lit(FUNNEL_STEPS[4]))
    return out.select(*[name.alias(c) if c == "funnel_name" else F.col(c) for c in _columns(g)])


def funnel_steps(t: RideTables, grain: str) -> DataFrame:
    """The long step table at one grain, without conversion columns."""
    g = GRAINS[grain]
    users = user_dim(t)
    return (_downloads(t, g)
            .unionByName(_signups(users, g))
            .unionByName(_ride_steps(t, users, g)))


def with_conversion(steps: DataFrame, segment: list[str]) -> DataFrame:
    """previous_users, pct_previous_value and pct_from_top per segment.

    A segment holds at most one row per step (four rows), so the window is
    trivially small; a zero denominator gives NULL instead of an error."""
    w = Window.partitionBy(*segment).orderBy("funnel_step")
    users = F.col("users")
    return steps.withColumns({
        "previous_users": F.lag(users).over(w),
        "pct_previous_value": ratio(users, F.lag(F.nullif(users, F.lit(0))).over(w)),
        "pct_from_top": ratio(users, F.first(F.nullif(users, F.lit(0))).over(w)),
    })


def _ordered(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def funnel_by_platform(t: RideTables) -> DataFrame:
    """Q01: platform funnel with step-to-step and from-the-top conversion."""
    out = with_conversion(funnel_steps(t, "platform"), ["platform"])
    return _ordered(out, ["funnel_step", "platform", "users"])


def funnel_by_age_platform(t: RideTables) -> DataFrame:
    """Q02: the same per age range x platform."""
    out = with_conversion(funnel_steps(t, "age_platform"), ["age_range", "platform"])
    return _ordered(out, ["funnel_step", "platform", "age_range", "users"])


def daily_cells(t: RideTables) -> DataFrame:
    """Q03's rows without the presentation sort -- the input of the panels and
    the store.  (A sort under an aggregate of doubles is not removed by the
    optimizer, so consumers must not inherit one.)"""
    return funnel_steps(t, "daily")


def funnel_daily(t: RideTables) -> DataFrame:
    """Q03: step x age x platform x day, no conversion columns, in step, day,
    platform, age order (NULLs last).  The result is bounded by the calendar
    (steps x ages x platforms x days), so the range sort is cheap."""
    return _ordered(daily_cells(t), ["funnel_step", "daily_date", "platform", "age_range"])


def funnel_daily_user(t: RideTables) -> DataFrame:
    """Q04: step x age x platform x day x user id.  Grows with the user base,
    so it is left unsorted; `sources.io.export_all_pages` writes it in total
    order with a distributed range sort."""
    return funnel_steps(t, "daily_user")


def funnel_totals(t: RideTables) -> DataFrame:
    """Q05: users at each step over all platforms, and each step's ratio to
    step 1 rounded to two decimals (HALF_UP)."""
    steps = funnel_steps(t, "platform")
    totals = steps.agg(*[
        F.sum(F.when(F.col("funnel_step") == k, F.col("users")).otherwise(F.lit(0)))
         .cast("bigint").alias(f"funnel_{k}") for k in FUNNEL_STEPS])
    return totals.select(
        *[f"funnel_{k}" for k in FUNNEL_STEPS],
        *[round_half_up_ratio(F.col(f"funnel_{k}"), F.col("funnel_1"), 2)
          .alias(f"funnel_{k}_ratio") for k in FUNNEL_STEPS])
