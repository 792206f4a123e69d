"""Named queries over a scale-factor directory: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators import charges, demand, drivers, funnel, reviews
from ridelens.operators.facts import rider_status
from ridelens.sources.adapter import from_driver_tables
from ridelens.sources.tables import RideTables

QueryFn = Callable[[SparkSession, str], DataFrame]


def _over_tables(op: Callable[[RideTables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(from_driver_tables(spark, sf_dir))
    run.__name__ = op.__name__
    run.__doc__ = op.__doc__
    return run


CORE_QUERIES: dict[str, Callable[[RideTables], DataFrame]] = {
    "funnel_by_platform": funnel.funnel_by_platform,
    "funnel_by_age_platform": funnel.funnel_by_age_platform,
    "funnel_daily": funnel.funnel_daily,
    "funnel_daily_user": funnel.funnel_daily_user,
    "funnel_totals": funnel.funnel_totals,
    "requests_by_hour": demand.requests_by_hour,
    "rides_per_user": demand.rides_per_user,
    "charge_status_stats": charges.charge_status_stats,
    "user_declines": charges.user_declines,
    "driver_declines": charges.driver_declines,
    "driver_rating_distribution": drivers.driver_rating_distribution,
    "driver_rating_summary": drivers.driver_rating_summary,
    "review_rating_stats": reviews.review_rating_stats,
    "rides_without_reviews": reviews.rides_without_reviews,
    "user_ride_status": rider_status,
    "user_ride_stats": demand.user_ride_stats,
    "reviews_per_user": reviews.reviews_per_user,
}


def queries() -> dict[str, QueryFn]:
    out = {name: _over_tables(op) for name, op in CORE_QUERIES.items()}
    from ridelens.plans.exchange import exchange_queries
    from ridelens.plans.panels import panel_queries
    from ridelens.plans.store import SessionStore
    from ridelens.plans.store_queries import store_queries
    store = SessionStore(from_driver_tables)
    out.update(panel_queries(store=store))
    out.update(exchange_queries(store=store))
    out.update(store_queries(store=store))
    return out
