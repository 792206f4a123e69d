"""Versioned datasets: nothing half published, single periods refreshed,
statistics instead of scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import SF_SMALL, spark_rows
from ridelens.operators import funnel, user_bitmaps
from ridelens.plans import panels, store
from ridelens.sources import io, versions
from ridelens.sources.adapter import from_driver_tables

DAYS = "step int, day date, n bigint, who string"


def rows_of(spark, values):
    def quoted(v):
        return "NULL" if v is None else f"'{v}'"
    listed = ", ".join(f"({s}, date {quoted(d)}, {n}L, {quoted(w)})" if d else f"({s}, NULL, {n}L, {quoted(w)})"
                       for s, d, n, w in values)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t(step, day, n, who)").to(StructType.fromDDL(DAYS))


OLD = [(1, "2021-01-05", 1, "a"), (1, "2021-02-05", 2, "b"), (2, "2021-02-28", 3, None), (2, "2021-03-01", 4, "a"),
       (1, None, 5, "c")]
NEW = [(1, "2021-01-05", 100, "z"), (1, "2021-02-07", 20, "y"), (2, "2021-03-01", 40, "x"), (2, "2021-04-01", 9, "a"),
       (2, None, 6, "d")]


@pytest.fixture()
def root(spark):
    return versions.publish(rows_of(spark, OLD), io.scratch_path(spark, "versions"), ["step"], "day", "month", ["who"])


@pytest.mark.parametrize("digits", ["123456789012", "12345678e012"])
def test_statistics_of_a_version_whose_id_looks_like_a_number(spark, monkeypatch, digits):
    class Fixed:
        hex = digits * 3
    path = io.scratch_path(spark, "versions")
    monkeypatch.setattr(versions.uuid, "uuid4", lambda: Fixed)
    versions.publish(rows_of(spark, OLD), path, ["step"], "day", "month", ["who"])
    monkeypatch.undo()
    assert versions.statistics(spark, path).agg(F.sum("n_rows")).first()[0] == len(OLD)
    assert versions.read(spark, path).count() == len(OLD)


def test_refresh_replaces_its_periods_only(spark, root):
    before = versions.read(spark, root)
    written = versions.refresh(rows_of(spark, NEW), root, dt.date(2021, 2, 20), dt.date(2021, 3, 2))
    assert written == ["step=1/store_period=2021-02-01", "step=2/store_period=2021-03-01",
                       f"step=2/store_period={versions.NO_PERIOD}"]
    # January stays as it was, April is not asked for, the step-2 rows of February are gone
    want = [OLD[0], *NEW[1:3], NEW[4]]
    assert spark_rows(versions.read(spark, root)) == spark_rows(rows_of(spark, want))
    assert spark_rows(before) == spark_rows(rows_of(spark, OLD))  # opened before: its own files
    stats = {(r["step"], str(r["store_period"])): r for r in versions.statistics(spark, root).collect()}
    assert set(stats) == {(1, "2021-01-01"), (1, "2021-02-01"), (2, "2021-03-01"), (2, "None")}
    assert stats[1, "2021-02-01"]["max_n"] == 20 and stats[1, "2021-02-01"]["values_who"] == ["y"]
    versions.refresh(rows_of(spark, NEW), root, dt.date(2021, 1, 31))
    assert spark_rows(versions.read(spark, root)) == spark_rows(rows_of(spark, NEW))


def test_a_failed_or_second_writer_changes_nothing(spark, root):
    failing = rows_of(spark, NEW).withColumn("n", F.when(F.col("n") == 40, F.raise_error(F.lit("planted")).cast("bigint"))
                                             .otherwise(F.col("n")))
    for attempt in (lambda: versions.refresh(failing, root, dt.date(2021, 2, 1)),
                    lambda: versions.publish(failing, root, ["step"], "day", "month")):
        with pytest.raises(Exception, match="planted"):
            attempt()
        assert spark_rows(versions.read(spark, root)) == spark_rows(rows_of(spark, OLD))
    number, manifest = versions.current(spark, root)
    versions.refresh(rows_of(spark, NEW), root, dt.date(2021, 2, 1))
    after = spark_rows(versions.read(spark, root))
    with pytest.raises(versions.Conflict):
        versions._commit(spark, root, number + 1, manifest)
    assert spark_rows(versions.read(spark, root)) == after
    with pytest.raises(ValueError):
        versions.refresh(rows_of(spark, NEW).withColumnRenamed("n", "m"), root, dt.date(2021, 2, 1))


@pytest.mark.parametrize("period,start,want", [("quarter", dt.date(2021, 2, 9), 5), ("year", dt.date(2021, 12, 31), 5),
                                               ("month", dt.date(2021, 4, 30), 6)])
def test_periods(spark, period, start, want):
    path = versions.publish(rows_of(spark, OLD), io.scratch_path(spark, "versions"), [], "day", period)
    versions.refresh(rows_of(spark, NEW), path, start)
    assert versions.read(spark, path).count() == want


def test_empty_and_expired(spark, root):
    empty = versions.publish(rows_of(spark, OLD).limit(0), io.scratch_path(spark, "versions"), ["step"], "day", "month")
    assert versions.read(spark, empty).schema.names == ["step", "day", "n", "who"]
    assert versions.read(spark, empty).count() == versions.statistics(spark, empty).count() == 0
    versions.refresh(rows_of(spark, OLD), empty, dt.date(2021, 1, 1))
    assert spark_rows(versions.read(spark, empty)) == spark_rows(rows_of(spark, OLD))
    for _ in range(3):
        versions.publish(rows_of(spark, NEW), root, ["step"], "day", "month")
    assert len(versions.expire(spark, root, keep=1)) == 3
    assert spark_rows(versions.read(spark, root)) == spark_rows(rows_of(spark, NEW))
    with pytest.raises(FileNotFoundError):
        versions.current(spark, f"{root}-absent")


def test_store_follows_new_days_and_users(spark):
    """Stored from the earlier rides and users, refreshed with all of them."""
    t = from_driver_tables(spark, SF_SMALL)
    cut = dt.date(1994, 5, 1)
    early = t.signups.where(F.col("signup_ts") < F.lit(cut))
    known = early.select("user_id")
    past = store.RideTables(t.app_downloads.where(F.col("download_ts") < F.lit(cut)), early,
                            t.ride_requests.join(known, "user_id").select(*t.ride_requests.columns),
                            t.transactions, t.reviews)
    root = io.scratch_path(spark, "store")
    names = ["funnel_daily", store.USER_BITMAPS, "user_ride_stats"]
    store.write_store(past, root, names, period="year")
    assert spark_rows(store.read_store(spark, root, names)["funnel_daily"]) != spark_rows(funnel.daily_cells(t))
    written = store.refresh_store(t, root, dt.date(1992, 1, 1), names=names)
    assert len(written["funnel_daily"]) > 6
    stored = store.read_store(spark, root, names)
    assert spark_rows(stored["funnel_daily"]) == spark_rows(funnel.daily_cells(t))
    assert spark_rows(panels.panel_user_funnel(stored[store.USER_BITMAPS])) == spark_rows(
        panels.panel_user_funnel(funnel.funnel_daily_user(t)))
    numbers = spark.read.parquet(f"{root}/{store.USER_NUMBERS}")
    assert numbers.select("_pos").distinct().count() == numbers.count() == user_bitmaps.entities(t).count()


def test_date_bounds_reach_the_scan_of_a_refresh(spark):
    """Only the days asked for are aggregated, not the whole funnel."""
    t = from_driver_tables(spark, SF_SMALL)
    df = funnel.daily_cells(t).where(F.col("daily_date") >= F.lit(dt.date(1995, 4, 1)))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # once in each branch, and in the scans' filters
    assert plan.count("1995-04-01") >= 4, plan
