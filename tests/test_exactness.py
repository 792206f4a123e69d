"""Amounts, means, grids and orders that must not depend on chance."""

from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from ridelens.functions.exprs import mean_of_means, usd
from ridelens.operators import charges, demand, funnel
from ridelens.operators.reshape import dense_grid, pivot_wide
from ridelens.plans import panels
from ridelens.sources.adapter import from_driver_tables


def test_amounts_below_a_cent_add_up(spark):
    df = spark.range(1000).select(F.lit(0.004).alias("a"))
    assert df.agg(F.round(F.sum(usd("a")), 2).cast("double")).first()[0] == 4.0


def test_pivot_loses_no_platform(spark):
    df = spark.createDataFrame([(1, "android", 2), (1, "tablet", 3), (1, None, 4), (1, "watch", 5)],
                               "step int, platform string, users bigint")
    row = pivot_wide(df, ["step"], "platform", ["android", "ios", "web"], "users").first()
    assert (row["android"], row["ios"], row["web"], row["other"]) == (2, None, None, 12)


def test_grid_takes_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2), (None, "x", 3)], "r string, c string, n bigint")
    got = {(x["r"], x["c"]): x["n"] for x in dense_grid(df, "r", "c", {"n": 0}).collect()}
    assert got == {("a", None): 1, ("a", "x"): 0, ("b", None): 0, ("b", "x"): 2, (None, None): 0, (None, "x"): 3}


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_mean_of_means_is_exact_for_any_partitioning(spark, parts):
    groups = [[3.09, 3.10], [1.005, 1.005], [2.675] * 3, [1 / 3, 2 / 3, 4.5], [4.125, 4.125]]
    rows = [(g, v) for g, vs in enumerate(groups) for v in vs]
    df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(mean_of_means("v", 2).alias("m")).collect()}
    for g, vs in enumerate(groups):
        exact = sum(Decimal(str(v)).quantize(Decimal("1e-10"), ROUND_HALF_UP) for v in vs) / len(vs)
        assert got[g] == float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_results_come_in_their_order(spark):
    t = from_driver_tables(spark, SF_SMALL)
    hours = [r[0] for r in demand.requests_by_hour(t).collect()]
    assert hours == sorted(hours)
    rides = [(r["rides"], r["user_id"]) for r in demand.rides_per_user(t).collect()]
    assert rides == sorted(rides)
    for build, key in ((charges.user_declines, "user_id"), (charges.driver_declines, "driver_id")):
        rows = [(-r["decline_count"], r[key]) for r in build(t).collect()]
        assert rows == sorted(rows)
    q1 = [(r["funnel_step"], r["platform"] is None, r["platform"] or "") for r in funnel.funnel_by_platform(t).collect()]
    assert q1 == sorted(q1)
    lines = [(r["daily_date"], r["platform"]) for r in panels.panel_daily_signups(funnel.daily_cells(t)).collect()]
    assert lines == sorted(lines)
