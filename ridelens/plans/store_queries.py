"""Registered queries over a store's ride cells and bitmaps, and the funnel at
all grains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators import charges, drivers, funnel, grains, reviews
from ridelens.plans import panels
from ridelens.plans.store import USER_BITMAPS, SessionStore
from ridelens.sources.adapter import from_driver_tables

# Core queries that meet transactions or reviews by ride.
FROM_FACTS = {
    "funnel_by_platform": funnel.funnel_by_platform,
    "funnel_by_age_platform": funnel.funnel_by_age_platform,
    "funnel_daily": funnel.funnel_daily,
    "funnel_daily_user": funnel.funnel_daily_user,
    "charge_status_stats": charges.charge_status_stats,
    "user_declines": charges.user_declines,
    "driver_declines": charges.driver_declines,
    "driver_rating_distribution": drivers.driver_rating_distribution,
    "driver_rating_summary": drivers.driver_rating_summary,
    "review_rating_stats": reviews.review_rating_stats,
    "rides_without_reviews": reviews.rides_without_reviews,
}
# Panels of distinct users over bitmaps: (panel, parameters).
FROM_BITMAPS = {
    "panel_user_funnel": (panels.panel_user_funnel, {}),
    "panel_user_funnel_ages": (panels.panel_user_funnel, panels.AGES),
    "panel_rides_funnel": (panels.panel_rides_funnel, {}),
    "panel_requesting_users": (panels.panel_requesting_users, {}),
    "panel_requesting_users_merged": (panels.panel_requesting_users, {"merge_ages": True}),
    "panel_completing_users": (panels.panel_completing_users, {}),
    "panel_completing_users_merged": (panels.panel_completing_users, {"merge_ages": True}),
}


def store_queries(load=None, store=None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """`load` and `store` as in `panels.panel_queries`."""
    load = load or from_driver_tables
    store = store or SessionStore(load)

    def from_facts(op):
        return lambda spark, sf_dir: op(store.tables(spark, sf_dir))

    def from_bitmaps(panel, params):
        return lambda spark, sf_dir: panel(store.dataset(spark, sf_dir, USER_BITMAPS), **params)
    return {
        **{f"{name}_from_facts": from_facts(op) for name, op in FROM_FACTS.items()},
        **{f"{name}_bitmap": from_bitmaps(*panel) for name, panel in FROM_BITMAPS.items()},
        "funnel_all_grains": lambda spark, sf_dir: grains.funnel_all_grains(load(spark, sf_dir)),
        "funnel_all_grains_from_facts": from_facts(grains.funnel_all_grains),
    }


def store_sql(core: dict, panel_sql: dict) -> dict[str, tuple[list[tuple[str, str]], str]]:
    """Each key's statement is that of the query it gives by another way."""
    all_grains = ([("g1", "funnel_by_platform"), ("g2", "funnel_by_age_platform"), ("g3", "funnel_daily"),
                   ("g4", "funnel_daily_user")], """
SELECT 'platform' AS grain, * EXCLUDE (previous_users, pct_previous_value, pct_from_top) FROM g1
UNION ALL BY NAME
SELECT 'age_platform' AS grain, * EXCLUDE (previous_users, pct_previous_value, pct_from_top) FROM g2
UNION ALL BY NAME SELECT 'daily' AS grain, * FROM g3
UNION ALL BY NAME SELECT 'daily_user' AS grain, * FROM g4""")
    return {
        **{f"{name}_from_facts": core[name] for name in FROM_FACTS},
        **{f"{name}_bitmap": panel_sql[name] for name in FROM_BITMAPS},
        "funnel_all_grains": all_grains, "funnel_all_grains_from_facts": all_grains,
    }
