"""The funnel at all four grains from one pass over every table.

`funnel.funnel_steps` builds one grain; four grains are four sets of scans and
joins.  Here each table is read once:

1. every ride becomes its request and, if it counts as completed, its
   completion, and these are reduced to (user, step, day) cells;
2. one outer join gives every signup its download's platform and keeps the
   downloads themselves, one left join gives every user's cells the user's age
   and platform and keeps the signups themselves: rows that stand for
   themselves carry another `role` than those that are looked up, so they match
   nothing;
3. the user cells are expanded twice: with and without their day (so that a
   user's days collapse before users are counted), then to the two grains each
   of these serves.  Both expansions sit above user cells and under a partial
   aggregate, and users are counted, not their distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.functions.exprs import day, ratio
from ridelens.operators.facts import TOTAL, ride_facts, times
from ridelens.sources.schemas import FUNNEL_STEPS
from ridelens.sources.tables import RideTables

MEASURES = {"n_rides": "bigint", "n_cancels": "bigint", "usd": TOTAL, "n_reviews": "bigint", "rating_sum": "bigint",
            "rating_n": "bigint"}
GRAIN_COLUMNS = ["grain", "funnel_step", "funnel_name", "users", "user_ids", "platform", "age_range", "total_usd",
                 "rides", "cancellations", "total_reviews", "avg_rating", "daily_date"]
SELF, LOOKED_UP = 0, 1


def _roles(*roles: int) -> Column:
    return F.explode(F.array(*[F.lit(r) for r in roles])).alias("role")


def ride_cells(t: RideTables) -> DataFrame:
    """rider_id, step, daily_date and the MEASURES of steps 3 and 4."""
    joined = F.coalesce("n_approved", F.lit(0)) * F.col("per_review")

    def none(c: str) -> Column:
        return F.lit(None).cast(MEASURES[c]).alias(c)
    requested = F.struct(
        F.lit(3).alias("step"), day("request_ts").alias("daily_date"),
        F.when(F.col("ride_id").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_rides"),
        F.when(F.col("cancel_ts").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_cancels"),
        *[none(c) for c in ("usd", "n_reviews", "rating_sum", "rating_n")])
    completed = F.struct(
        F.lit(4).alias("step"), day("dropoff_ts").alias("daily_date"), joined.alias("n_rides"),
        F.when(F.col("cancel_ts").isNotNull(), joined).otherwise(0).alias("n_cancels"),
        times("approved_usd", "per_review").cast(TOTAL).alias("usd"),
        F.coalesce("n_review_ids", F.lit(0)).alias("n_reviews"),
        (F.col("rating_sum") * F.col("n_approved")).alias("rating_sum"),
        (F.coalesce("rating_n", F.lit(0)) * F.col("n_approved")).alias("rating_n"))
    done = F.col("dropoff_ts").isNotNull() & (F.col("n_approved") > 0)
    events = ride_facts(t).where(F.col("user_id").isNotNull()).select(
        F.col("user_id").alias("rider_id"),
        F.explode(F.when(done, F.array(requested, completed)).otherwise(F.array(requested))).alias("e"))
    return (events.groupBy("rider_id", "e.step", "e.daily_date")
            .agg(*[F.sum(f"e.{c}").cast(kind).alias(c) for c, kind in MEASURES.items()]))


def _people(t: RideTables) -> DataFrame:
    """Downloads (role SELF, no user) and signups with their platform."""
    downloads = t.app_downloads.select("app_download_key", F.col("platform").alias("platform"), "download_ts",
                                       _roles(SELF, LOOKED_UP))
    signups = t.signups.select("user_id", "session_id", "signup_ts", "age_range", F.lit(True).alias("signed_up"))
    met = signups.join(downloads, (F.col("session_id") == F.col("app_download_key"))
                       & (F.col("role") == LOOKED_UP), "full")
    # a download that was only looked up, and by nobody, is no row
    return met.where(F.col("signed_up") | (F.col("role") == SELF))


def _cells(t: RideTables) -> DataFrame:
    """step, id, age_range, platform, daily_date and MEASURES: one row per
    download, per signup, per rider's step and day, and (id NULL, platform NULL,
    step 3) per signup that never rode."""
    people = _people(t).select("*", F.explode(F.when(
        F.col("signed_up"), F.array(F.lit(SELF), F.lit(LOOKED_UP))).otherwise(F.array(F.lit(SELF)))).alias("as"))
    rides = ride_cells(t)
    met = people.join(rides, (F.col("user_id") == F.col("rider_id")) & (F.col("as") == LOOKED_UP), "left")
    signed_up, looked_up = F.col("signed_up"), F.col("as") == LOOKED_UP
    rider = F.col("rider_id")
    return met.select(
        F.when(looked_up, F.coalesce("step", F.lit(3))).when(signed_up, 2).otherwise(1).alias("funnel_step"),
        F.when(looked_up, rider.cast("string")).when(signed_up, F.col("user_id").cast("string"))
        .otherwise(F.col("app_download_key")).alias("id"),
        "age_range",
        F.when(~looked_up | rider.isNotNull(), F.col("platform")).alias("platform"),
        F.when(looked_up, F.col("daily_date")).when(signed_up, day("signup_ts"))
        .otherwise(day("download_ts")).alias("daily_date"),
        *MEASURES)


def funnel_all_grains(t: RideTables) -> DataFrame:
    """Q01-Q04's step rows in one result: `grain` names the grain; `users` is
    NULL at the per-user grain and `user_ids` at the others, and so are the keys
    a grain does not have.  Conversions follow with `funnel.with_conversion` on
    the rows of a grain."""
    def sums() -> list[Column]:
        return [F.sum(c).cast(kind).alias(c) for c, kind in MEASURES.items()]
    every, filler = F.col("daily_date"), F.lit(None).cast("date")
    by_day = _cells(t).withColumn("d", F.explode(F.array(
        F.struct(F.lit(True).alias("daily"), every.alias("day")), F.struct(F.lit(False).alias("daily"), filler.alias("day")))))
    users = (by_day.groupBy("d.daily", "funnel_step", "id", "age_range", "platform", F.col("d.day").alias("day"))
             .agg(F.count("id").alias("n"), *sums()))

    def grain(name: str, *, step=F.col("funnel_step"), age=F.col("age_range"), platform=F.col("platform"),
              user=F.lit(None).cast("string"), unlisted=False) -> Column:
        return F.struct(F.lit(name).alias("grain"), step.alias("funnel_step"), age.alias("age_range"),
                        platform.alias("platform"), user.alias("user_ids"), F.lit(unlisted).alias("unlisted"))
    nothing = F.lit(None).cast("string")
    daily = F.array(grain("daily"), grain("daily_user", user=F.col("id")))
    whole = F.array(grain("age_platform"), grain("platform", age=nothing))
    # every signup's age once more at step 1, without users or platform
    signups = F.concat(whole, F.array(
        grain("age_platform", step=F.lit(1), platform=nothing, unlisted=True),
        grain("platform", step=F.lit(1), age=nothing, platform=nothing, unlisted=True)))
    cells = users.withColumn("g", F.explode(
        F.when(F.col("daily"), daily).when(F.col("funnel_step") == 2, signups).otherwise(whole)))
    # downloads of a day are counted as rows, users once each
    counted = F.when((F.col("g.grain") == "daily") & (F.col("g.funnel_step") == 1), F.col("n")).otherwise(
        F.col("id").isNotNull().cast("bigint"))
    out = (cells.groupBy("g.grain", "g.funnel_step", "g.age_range", "g.platform", "g.user_ids", "g.unlisted", "day")
           .agg(F.sum(counted).alias("users"), *sums()))
    rides, step4 = F.col("funnel_step") >= 3, F.col("funnel_step") == 4
    name = F.create_map(*[F.lit(x) for pair in FUNNEL_STEPS.items() for x in pair])
    return out.select(
        "grain", "funnel_step", F.element_at(name, F.col("funnel_step")).alias("funnel_name"),
        F.when((F.col("grain") != "daily_user") & ~F.col("unlisted"), F.col("users")).alias("users"),
        "user_ids", "platform", "age_range",
        F.when(step4, F.round("usd", 0).cast("bigint")).alias("total_usd"),
        F.when(rides, F.coalesce("n_rides", F.lit(0))).alias("rides"),
        F.when(rides, F.coalesce("n_cancels", F.lit(0))).alias("cancellations"),
        F.when(step4, F.col("n_reviews")).alias("total_reviews"),
        F.when(step4, ratio(F.col("rating_sum"), F.col("rating_n"))).alias("avg_rating"),
        F.col("day").alias("daily_date")).select(*GRAIN_COLUMNS)
