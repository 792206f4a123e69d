"""Cross-query invariants on the derived tables (sf0.01), over the rides of
signed-up users: the funnel only knows those."""

import pytest
from pyspark.sql import functions as F

from helpers import SF_MEDIUM
from ridelens.operators import charges, demand, funnel
from ridelens.plans import panels
from ridelens.sources.adapter import from_driver_tables
from ridelens.sources.tables import RideTables


@pytest.fixture(scope="module")
def tables(spark):
    t = from_driver_tables(spark, SF_MEDIUM)
    rides = t.ride_requests.join(t.signups, "user_id", "left_semi")
    return RideTables(t.app_downloads, t.signups, rides, t.transactions.join(rides, "ride_id", "left_semi"),
                      t.reviews.join(rides, "ride_id", "left_semi"))


@pytest.fixture(scope="module")
def by_platform(tables):
    return {(r.funnel_step, r.platform): r for r in funnel.funnel_by_platform(tables).collect()}


@pytest.fixture(scope="module")
def charge(tables):
    return {r.charge_status: r for r in charges.charge_status_stats(tables).collect()}


def _step_sum(rows, step, field):
    return sum(getattr(r, field) or 0 for (s, _), r in rows.items() if s == step)


def test_i1_hours_sum_to_requested_rides(tables, by_platform):
    hours = demand.requests_by_hour(tables).agg(F.sum("num_requests")).first()[0]
    assert hours == _step_sum(by_platform, 3, "rides")


def test_i2_rides_balance(by_platform, charge):
    kept = _step_sum(by_platform, 3, "rides") - _step_sum(by_platform, 3, "cancellations")
    assert kept == charge["Approved"].rides + charge["Decline"].rides


def test_i3_i4_completed_equals_approved(by_platform, charge):
    assert _step_sum(by_platform, 4, "rides") == charge["Approved"].rides
    assert _step_sum(by_platform, 4, "total_reviews") == charge["Approved"].reviews


def test_i5_ages_add_up(tables, by_platform):
    by_age = funnel.funnel_by_age_platform(tables).collect()
    for step in (2, 3, 4):
        for field in ("users", "rides", "cancellations", "total_reviews"):
            aged = sum(getattr(r, field) or 0 for r in by_age if r.funnel_step == step)
            assert aged == _step_sum(by_platform, step, field), (step, field)


def test_i6_usd_agrees_within_rounding(by_platform, charge):
    groups = [r for (s, _), r in by_platform.items() if s == 4]
    total = sum(r.total_usd for r in groups)
    assert abs(total - charge["Approved"].total_usd) <= 0.5 * len(groups)


def test_i8_funnel_never_increases(by_platform):
    for platform in ("android", "ios", "web"):
        users = [by_platform[(s, platform)].users for s in (1, 2, 3, 4)]
        assert users == sorted(users, reverse=True)


def test_step_one_segments_have_full_conversion(by_platform):
    for platform in ("android", "ios", "web"):
        row = by_platform[(1, platform)]
        assert row.pct_from_top == 1.0 and row.previous_users is None


def test_merged_sums_equal_unmerged_sums(tables):
    daily = funnel.funnel_daily(tables)
    split = panels.panel_rides_requested(daily).agg(F.sum("rides")).first()[0]
    merged = panels.panel_rides_requested(daily, merge_ages=True).agg(F.sum("rides")).first()[0]
    assert split == merged


def test_widening_a_filter_never_lowers_a_sum(tables):
    daily = funnel.funnel_daily(tables)
    narrow = panels.panel_rides_completed(daily, start_date="1996-01-01", end_date="1996-06-30",
                                          start_platform="ios", end_platform="ios")
    wide = panels.panel_rides_completed(daily, start_date="1995-06-01", end_date="1997-06-30")
    assert (narrow.agg(F.sum("rides")).first()[0]
            <= wide.agg(F.sum("rides")).first()[0])


def test_distinct_users_are_not_additive_across_days(tables):
    per_user = funnel.funnel_daily_user(tables)
    merged = panels.panel_requesting_users(per_user, merge_ages=True)
    by_platform = {r.platform: r.users for r in merged.collect()}
    total = funnel.funnel_by_platform(tables).where("funnel_step = 3 AND platform IS NOT NULL")
    assert by_platform == {r.platform: r.users for r in total.collect()}
