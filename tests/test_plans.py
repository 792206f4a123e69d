"""Physical-plan properties every registered query must keep at scale.

Plans are taken with broadcasting disabled, which is how they look when every
table is far above the broadcast threshold."""

import re

import pytest

from helpers import SF_SMALL
from ridelens.plans import registry

WRITES = {"csv_roundtrip", "merge_shards", "export_page", "export_all_pages", "export_page_files",
          "merge_drifting", "csv_rejects", "funnel_daily_refreshed", "panel_driver_ratings_clustered",
          "download_numbers", "driver_summary_stored",
          "panel_signups_stored", "panel_daily_rides_usd_stored", "panel_user_funnel_stored"}
NAMES = sorted(n for n in registry.queries() if n not in WRITES)
# Queries whose single-partition step only sees bounded aggregates: a global
# total (one row per partition in), the funnel totals, the dense grid over
# ages x platforms, the slider maxima.
BOUNDED_SINGLE = {"funnel_totals", "slider_bounds", "slider_bounds_statistics",
                  "slider_bounds_user_stats_statistics", "slider_bounds_user_declines_statistics",
                  "slider_bounds_driver_declines_statistics", "slider_bounds_user_stats", "slider_bounds_user_declines",
                  "slider_bounds_driver_declines", "panel_rides_requested_window", "panel_signups_ios",
                  "panel_signups", "panel_requesting_users", "panel_rides_requested", "panel_completing_users",
                  "panel_rides_completed", "panel_usd", "panel_avg_rating", "panel_signups_raw",
                  "panel_requesting_users_bitmap", "panel_completing_users_bitmap"}


@pytest.fixture(scope="module")
def plans(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        qs = registry.queries()
        yield {n: qs[n](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
               for n in NAMES}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_python(plans, name):
    plan = plans[name]
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", NAMES)
def test_single_partition_only_on_bounded_data(plans, name):
    if "Exchange SinglePartition" in plans[name]:
        assert name in BOUNDED_SINGLE


@pytest.mark.parametrize("name", NAMES)
def test_aggregates_are_partial_before_shuffles(plans, name):
    """Every hash exchange fed by an aggregate is fed by its map-side half, so
    a hot key is collapsed inside each task before it is shuffled."""
    lines = plans[name].splitlines()
    for i in range(1, len(lines) - 1):
        parent, line, child = lines[i - 1], lines[i], lines[i + 1]
        if ("Exchange hashpartitioning" in line and "HashAggregate(" in parent
                and "HashAggregate(" in child):
            assert re.search(r"functions=\[(\]|partial_|merge_)", child), child


def test_scans_prune_columns(plans):
    plan = plans["requests_by_hour"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name,most", [("user_declines", 6), ("driver_declines", 6), ("review_rating_stats", 7)])
def test_shuffle_counts(plans, name, most):
    """Each table shuffles by ride once; then the distinct count and the sort."""
    executed = [x for x in plans[name].splitlines() if " Exchange " in x and "Reused" not in x]
    assert len(executed) <= most, executed
    assert "Expand" not in plans[name]
