"""Hand-made edge rows for the null and boundary rules of every operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelens.operators import charges, demand, drivers, funnel, reviews
from ridelens.operators.filters import (age_between_null_tolerant, age_between_unless_unset,
                                        text_between)
from ridelens.operators.reshape import histogram
from ridelens.plans import panels
from ridelens.sources.schemas import (APP_DOWNLOADS, REVIEWS, RIDE_REQUESTS, SIGNUPS,
                                      TRANSACTIONS)
from ridelens.sources.tables import RideTables


def ts(day, hour=0, minute=0):
    return dt.datetime(2021, 2, day, hour, minute)


@pytest.fixture(scope="module")
def t(spark):
    downloads = [("d1", "android", ts(1)), ("d2", "ios", ts(1)), ("d3", "web", ts(2)),
                 ("d4", "ios", ts(3)), ("d5", "android", ts(3))]
    signups = [(1, "d1", ts(2), "18-24"), (2, "d2", ts(2), "25-34"),
               (4, "d4", ts(4), "35-44"), (5, "d5", ts(4), None)]
    rides = [
        (101, 1, 10, ts(10, 8), ts(10, 8, 30), None),   # approved, reviewed 5
        (102, 1, 10, ts(10, 9), ts(10, 9, 30), None),   # declined, reviewed 1
        (103, 1, None, ts(11, 9), None, ts(11, 9, 5)),  # cancelled, no driver
        (104, 4, 11, ts(12, 9), None, None),            # neither dropped off nor cancelled
        (105, 4, 11, ts(12, 10), ts(12, 10, 20), None), # dropped off, no transaction
        (106, 9, 12, ts(13, 17), ts(13, 17, 20), None), # rider missing from signups
        (107, 1, 10, ts(14, 8), ts(14, 8, 10), None),   # declined, no review
        (108, 4, 11, ts(14, 8), ts(14, 8, 10), None),   # declined, reviewed 2
        (109, 6, 13, ts(15, 8), None, None),            # only ride, neither state
    ]
    tx = [(101, 10.50, "Approved"), (102, 20.00, "Decline"), (106, 7.25, "Approved"),
          (107, 5.00, "Decline"), (108, 3.00, "Decline")]
    rv = [(1101, 101, 1, 5), (1102, 102, 1, 1), (1108, 108, 4, 2)]
    return RideTables(spark.createDataFrame(downloads, APP_DOWNLOADS),
                      spark.createDataFrame(signups, SIGNUPS),
                      spark.createDataFrame(rides, RIDE_REQUESTS),
                      spark.createDataFrame(tx, TRANSACTIONS),
                      spark.createDataFrame(rv, REVIEWS))


def by_key(df, *keys):
    return {tuple(getattr(r, k) for k in keys): r for r in df.collect()}


def test_platform_funnel_edges(t):
    rows = by_key(funnel.funnel_by_platform(t), "funnel_step", "platform")
    # download without signup still counts at step 1; one empty filler row
    assert rows[(1, "web")].users == 1 and rows[(1, None)].users is None
    assert rows[(2, "android")].users == 2 and rows[(2, "ios")].users == 2
    # signups that never rode: NULL platform, zero users and rides
    assert (rows[(3, None)].users, rows[(3, None)].rides) == (0, 0)
    assert (rows[(3, "android")].rides, rows[(3, "android")].cancellations) == (4, 1)
    # the rider missing from signups is not in steps 3-4
    assert rows[(3, "ios")].rides == 3
    # step 4: only dropped-off Approved rides; 10.50 rounds HALF_UP to 11
    r4 = rows[(4, "android")]
    assert (r4.users, r4.rides, r4.total_usd, r4.total_reviews, r4.avg_rating) == (1, 1, 11, 1, 5.0)
    assert (4, "ios") not in rows
    assert r4.pct_previous_value == 1.0 and r4.pct_from_top == 0.5


def test_age_funnel_starts_at_signups(t):
    rows = by_key(funnel.funnel_by_age_platform(t), "funnel_step", "age_range", "platform")
    assert rows[(2, "18-24", "android")].pct_from_top == 1.0
    fillers = {k[1] for k in rows if k[0] == 1 and k[2] is None}
    assert fillers == {"18-24", "25-34", "35-44", None}


def test_daily_keeps_null_day_for_non_riders(t):
    rows = funnel.funnel_daily(t).where("funnel_step = 3 AND platform IS NULL").collect()
    assert {(r.age_range, r.daily_date, r.users, r.rides) for r in rows} == {
        ("25-34", None, 0, 0), (None, None, 0, 0)}


def test_daily_user_ids(t):
    rows = funnel.funnel_daily_user(t).collect()
    step1 = {r.user_ids for r in rows if r.funnel_step == 1}
    assert step1 == {"d1", "d2", "d3", "d4", "d5"}
    nulls = [r for r in rows if r.funnel_step == 3 and r.user_ids is None]
    assert len(nulls) == 2 and all(r.rides == 0 for r in nulls)


def test_hours_and_charges_include_unknown_riders(t):
    hours = by_key(demand.requests_by_hour(t), "request_hour")
    assert hours[(17,)].num_requests == 1
    stats = by_key(charges.charge_status_stats(t), "charge_status")
    assert stats[("Approved",)].rides == 2 and stats[("Decline",)].rides == 3
    assert stats[("Approved",)].total_usd == 17.75
    assert stats[("Decline",)].users == 2  # reviewers only: users 1 and 4


def test_declines_need_more_than_one(t):
    users = by_key(charges.user_declines(t), "user_id")
    assert set(users) == {(1,)}
    u1 = users[(1,)]
    assert (u1.decline_count, u1.unique_rides, u1.unique_drivers) == (2, 4, 1)
    assert u1.avg_rating == 1.0 and u1.lost_total_usd == 25.0 and u1.gained_total_usd == 10.5
    assert set(by_key(charges.driver_declines(t), "driver_id")) == {(10,)}


def test_null_driver_forms_its_own_group(t):
    dist = by_key(drivers.driver_rating_distribution(t), "driver_id")
    assert (None,) in dist and dist[(None,)].rides_canceled == 1
    summary = by_key(drivers.driver_rating_summary(t), "driver_id")
    assert summary[(10,)].avg_ratings == 3.0 and summary[(None,)].avg_ratings is None


def test_review_stats_and_unreviewed(t):
    stats = by_key(reviews.review_rating_stats(t), "rating")
    assert stats[(None,)].rides == 6 and stats[(None,)].reviews is None
    assert {r.ride_id for r in reviews.rides_without_reviews(t).collect()} == {
        103, 104, 105, 106, 107, 109}


def test_user_types(t):
    types = by_key(panels.panel_user_types(demand.user_ride_stats(t)), "user_id")
    assert types[(1,)].user_type == "Mixed"
    assert types[(4,)].user_type == "Full Completed Rides"
    assert types[(6,)].user_type == "Mixed"  # zero completed and zero cancelled


def test_histogram_bins(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([0, 4, 5, 59, 60])],
                               "user_id bigint, rides bigint")
    bins = {r.bin_label: r.users for r in histogram(df, "rides", "user_id", 5, 12).collect()}
    assert len(bins) == 13
    assert bins["0-5"] == 2 and bins["5-10"] == 1 and bins["55-60"] == 1 and bins["60+"] == 1
    assert sum(bins.values()) == 5  # nobody is lost


def test_age_filters(spark):
    df = spark.createDataFrame([("18-24",), ("45-54",), ("Unknown",), (None,)], "age_range string")

    def kept(cond):
        return sorted((r.age_range or "<null>") for r in df.where(cond).collect())

    assert kept(text_between("age_range", "18-24", "Unknown")) == ["18-24", "45-54", "Unknown"]
    assert kept(age_between_unless_unset("age_range", "None", "Unknown")) == [
        "18-24", "45-54", "<null>", "Unknown"]
    # the sentinel as a lower bound keeps only 'Unknown' (digits < 'N' < 'U')
    assert kept(age_between_null_tolerant("age_range", "None", "Unknown")) == ["Unknown"]
    assert kept(age_between_null_tolerant("age_range", "18-24", "25-34")) == ["18-24", "Unknown"]


def test_dense_grid_fills_missing_pairs(spark):
    daily = spark.createDataFrame(
        [(4, "18-24", "ios", 3, 2.0, dt.date(2021, 1, 1)),
         (4, "25-34", "web", 5, 4.0, dt.date(2021, 1, 1)),
         (4, "25-34", "web", 1, 3.0, dt.date(2021, 1, 2))],
        "funnel_step int, age_range string, platform string, rides bigint, "
        "avg_rating double, daily_date date")
    rides = by_key(panels.panel_rides_completed(daily), "age_range", "platform")
    assert len(rides) == 4
    assert rides[("18-24", "web")].rides == 0 and rides[("25-34", "web")].rides == 6
    assert rides[("18-24", "web")].label == "18-24 - web"
    rating = by_key(panels.panel_avg_rating(daily), "age_range", "platform")
    assert rating[("25-34", "ios")].avg_rating is None
    assert rating[("25-34", "web")].avg_rating == 3.5


def test_half_up_rounding_of_ratios(spark):
    from ridelens.functions.exprs import round_half_up_ratio
    cols = [round_half_up_ratio(F.lit(n), F.lit(d), 2).alias(f"q{i}")
            for i, (n, d) in enumerate([(623, 200), (6225, 2000), (1, 3), (5, 0)])]
    row = spark.range(1).select(*cols).first()
    # 3.115 -> 3.12 and 3.1125 -> 3.11 (exact quotient, HALF_UP); x/0 -> NULL
    assert (row.q0, row.q1, row.q2, row.q3) == (3.12, 3.11, 0.33, None)
