"""Ride cells and the store: results as over the raw tables, joins by ride
without an exchange."""

import pytest

from helpers import SF_SMALL, spark_rows
from ridelens.plans import store
from ridelens.plans.registry import CORE_QUERIES
from ridelens.plans.ride_store import read_ride_cells
from ridelens.sources import buckets, io
from ridelens.sources.adapter import from_driver_tables
from test_fuzz import generate
from ridelens.sources.schemas import TABLE_SCHEMAS
from ridelens.sources.tables import RideTables

BY_RIDE = ["funnel_by_platform", "funnel_by_age_platform", "funnel_daily", "funnel_daily_user", "charge_status_stats",
           "user_declines", "driver_declines", "driver_rating_distribution", "driver_rating_summary",
           "review_rating_stats", "rides_without_reviews"]


@pytest.fixture(scope="module")
def stored(spark):
    return store.write_ride_store(from_driver_tables(spark, SF_SMALL), io.scratch_path(spark, "store"), buckets=5)


@pytest.fixture(scope="module")
def odd(spark):
    """Random tables with fan-out, orphans and reviews and charges without a ride."""
    data = generate(11)
    data["reviews"] += [(20000, None, 4, 5), (20001, None, 4, 5), (20002, None, None, None), (20003, 999, 4, 1)]
    data["transactions"] += [(None, 3.5, "Approved"), (None, 1.0, None), (999, 2.0, "Decline")]
    raw = RideTables(*[spark.createDataFrame(data[n], TABLE_SCHEMAS[n]) for n in TABLE_SCHEMAS])
    return raw, store.write_ride_store(raw, io.scratch_path(spark, "store"), buckets=3)


@pytest.mark.parametrize("name", sorted(CORE_QUERIES))
def test_cells_give_the_results_of_the_raw_tables(odd, name):
    raw, cells = odd
    query = CORE_QUERIES[name]
    assert spark_rows(query(cells)) == spark_rows(query(raw))


@pytest.fixture(scope="module")
def plans(spark, stored):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield {n: CORE_QUERIES[n](stored)._jdf.queryExecution().executedPlan().toString() for n in BY_RIDE}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", BY_RIDE)
def test_no_exchange_by_ride(plans, name):
    """Joins on ride_id read the buckets as they lie, and nothing is dealt by it."""
    plan = plans[name]
    assert "ride_id" not in "".join(x.split("Exchange ")[1] for x in plan.splitlines() if "Exchange hash" in x), plan
    if "SortMergeJoin [ride_id" in plan:
        assert "Bucketed: true" in plan


@pytest.mark.parametrize("name", ["user_declines", "driver_declines", "driver_rating_summary", "rides_without_reviews"])
def test_rides_alone_answer(plans, name):
    assert "[ride_id" not in "".join(x for x in plans[name].splitlines() if "Join" in x)


def test_one_file_a_bucket(spark, stored):
    rides = spark.read.parquet(stored.cells["rides"].inputFiles()[0].rsplit("/", 1)[0])
    assert len(rides.inputFiles()) == 5  # one file a bucket


def test_other_sessions_open_the_same_buckets(spark, odd):
    raw, cells = odd
    root = io.scratch_path(spark, "store")
    store.write_ride_store(raw, root, buckets=4)
    path = f"{root}/{store.RIDE_CELLS}"
    before = spark_rows(read_ride_cells(spark, path)["rides"])
    for name in ("rides", "charges", "reviews"):
        spark.sql(f"DROP TABLE {buckets._table(f'{path}/{name}')}")  # as a new session knows no table
    again = store.open_ride_store(raw, root)
    assert spark_rows(again.cells["rides"]) == before
    detail = spark.sql(f"DESCRIBE EXTENDED {buckets._table(f'{path}/rides')}").collect()
    assert {r["col_name"]: r["data_type"] for r in detail}["Num Buckets"] == "4"


def test_one_ride_per_row(odd):
    raw, cells = odd
    assert cells.cells["rides"].count() == raw.ride_requests.count()
    assert cells.cells["charges"].groupBy("ride_id", "charge_status").count().where("count > 1").count() == 0
    assert cells.cells["lost_reviews"].count() == 2


def test_write_store_holds_the_ride_cells(spark):
    t, root = from_driver_tables(spark, SF_SMALL), io.scratch_path(spark, "store")
    store.write_store(t, root, ["user_declines"])
    assert spark_rows(store.read_store(spark, root, ["user_declines"])["user_declines"]) == \
        spark_rows(CORE_QUERIES["user_declines"](t))
    assert spark_rows(CORE_QUERIES["funnel_by_platform"](store.open_ride_store(t, root))) == \
        spark_rows(CORE_QUERIES["funnel_by_platform"](t))


def test_empty_tables(spark):
    raw = RideTables(*[spark.createDataFrame([], TABLE_SCHEMAS[n]) for n in TABLE_SCHEMAS])
    cells = store.write_ride_store(raw, io.scratch_path(spark, "store"), buckets=2)
    assert spark_rows(CORE_QUERIES["review_rating_stats"](cells)) == spark_rows(CORE_QUERIES["review_rating_stats"](raw))
    assert cells.cells["rides"].count() == 0
