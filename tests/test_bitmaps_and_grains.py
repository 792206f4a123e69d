"""Distinct users as ORs of stored bitmaps; all grains from one pass."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, spark_rows
from ridelens.operators import funnel, grains, user_bitmaps
from ridelens.plans import panels, store
from ridelens.sources import io
from ridelens.sources.adapter import from_driver_tables
from ridelens.sources.schemas import TABLE_SCHEMAS
from ridelens.sources.tables import RideTables
from test_fuzz import generate


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    data = generate(5)
    return RideTables(*[spark.createDataFrame(data[n], TABLE_SCHEMAS[n]) for n in TABLE_SCHEMAS])


@pytest.fixture(scope="module")
def cells(spark, tables):
    root = io.scratch_path(spark, "store")
    store.write_dataset(tables, root, store.USER_BITMAPS)
    return store.read_store(spark, root, [store.USER_BITMAPS])[store.USER_BITMAPS]


@pytest.mark.parametrize("keys", [[], ["platform"], ["age_range"], ["funnel_step"], ["funnel_step", "platform"],
                                  ["funnel_step", "age_range", "platform"], user_bitmaps.CELL_KEYS])
@pytest.mark.parametrize("days", [None, ("1995-03-05", "1995-03-20")])
def test_any_merge_of_cells_is_exact(tables, cells, keys, days):
    """Every window and every set of kept dimensions, step by step."""
    per_user = funnel.funnel_daily_user(tables)
    for step in (2, 3, 4) if "funnel_step" not in keys else (None,):
        def cut(df):
            df = df if step is None else df.where(F.col("funnel_step") == step)
            return df if days is None else df.where(F.col("daily_date").between(*days))
        want = cut(per_user).groupBy(*keys).agg(F.count_distinct("user_ids").alias("users"),
                                                F.sum("rides").alias("rides"))
        got = user_bitmaps.distinct_users(cut(cells), keys, rides=True)
        if not keys:  # a global count of nothing has no blocks to add up
            got = got.withColumn("users", F.coalesce("users", F.lit(0)))
        assert spark_rows(got) == spark_rows(want)


def test_blocks_beyond_the_first(spark):
    """More users than a block holds, and merges across blocks."""
    rng = random.Random(3)
    rows = [(3, "rides_requested", rng.choice(["ios", "web"]), "18-24", None, str(rng.randrange(70_000)), 1)
            for _ in range(30_000)]
    daily_user = spark.createDataFrame(rows, "funnel_step int, funnel_name string, platform string, age_range string, "
                                             "daily_date date, user_ids string, rides long")
    numbers = spark.range(70_000).select(F.lit(2).alias("kind"), F.col("id").cast("string").alias("id"),
                                         F.col("id").alias("_pos"))
    made = user_bitmaps.user_cells(daily_user, numbers)
    assert made.select("block").distinct().count() == 3
    got = user_bitmaps.distinct_users(made, ["funnel_step"], rides=True).first()
    assert (got["users"], got["rides"]) == (len({r[5] for r in rows}), 30_000)


def test_panels_read_no_row_of_a_user(spark, cells):
    for df in (panels.panel_user_funnel(cells), panels.panel_requesting_users(cells),
               panels.panel_completing_users(cells, merge_ages=True)):
        plan = plan_of(df)
        assert "user_ids" not in plan and "bitmap_or_agg" in plan
        assert plan.count("FileScan") >= 1 and "ReadSchema: struct<" in plan


def test_numbers_are_dense_and_kept(spark, tables):
    root = io.scratch_path(spark, "store")
    store.write_dataset(tables, root, store.USER_BITMAPS)
    numbers = spark.read.parquet(f"{root}/{store.USER_NUMBERS}")
    before = spark_rows(numbers)
    n = numbers.count()
    assert sorted(r["_pos"] for r in numbers.collect()) == list(range(n))
    assert n == tables.app_downloads.count() + tables.signups.count()
    store.write_dataset(tables, root, store.USER_BITMAPS)  # numbers given once stay
    assert spark_rows(spark.read.parquet(f"{root}/{store.USER_NUMBERS}")) == before


def test_grains_equal_the_builder_of_one_grain(tables):
    rows = grains.funnel_all_grains(tables)
    for name in funnel.GRAINS:
        want = funnel.funnel_steps(tables, name)
        assert spark_rows(rows.where(F.col("grain") == name).select(*want.columns)) == spark_rows(want), name


def test_conversions_follow_from_a_grain(spark):
    t = from_driver_tables(spark, SF_SMALL)
    steps = grains.funnel_all_grains(t).where("grain = 'platform'")
    want = funnel.funnel_by_platform(t)
    assert spark_rows(funnel.with_conversion(steps, ["platform"]).select(*want.columns)) == spark_rows(want)


def test_grains_scan_every_table_once(spark):
    raw = {n: spark.createDataFrame([], s) for n, s in TABLE_SCHEMAS.items()}
    paths = {}
    for n, df in raw.items():
        paths[n] = io.scratch_path(spark, n)
        df.write.parquet(paths[n])
    t = RideTables(*[spark.read.schema(TABLE_SCHEMAS[n]).parquet(paths[n]) for n in TABLE_SCHEMAS])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(grains.funnel_all_grains(t))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for n in TABLE_SCHEMAS:
        assert plan.count(paths[n].rsplit("/", 1)[1]) == 1, n
    assert grains.funnel_all_grains(t).count() == 0


def test_people_of_odd_sessions(spark):
    """Downloads nobody signed up from, two signups of one download, signups
    without a session or with an unknown one, downloads without a platform."""
    def frame(name, rows):
        return spark.createDataFrame(rows, TABLE_SCHEMAS[name])
    import datetime as dt
    day = dt.datetime(2024, 1, 2)
    t = RideTables(
        frame("app_downloads", [("a", "ios", day), ("b", None, day), ("c", "web", None), ("d", "ios", day)]),
        frame("signups", [(1, "a", day, "18-24"), (2, "a", day, None), (3, None, day, "18-24"), (4, "x", None, "25-34"),
                          (5, "b", day, "18-24")]),
        frame("ride_requests", [(10, 1, 7, day, day, None), (11, 1, 7, None, None, day), (12, 9, 7, day, None, None),
                                (13, None, 7, day, None, None), (14, 5, None, day, day, day)]),
        frame("transactions", [(10, 2.5, "Approved"), (10, 1.0, "Approved"), (14, None, "Approved"), (11, 1.0, "Decline")]),
        frame("reviews", [(100, 10, 1, 5), (101, 10, 2, None), (102, 14, 5, 4)]))
    rows = grains.funnel_all_grains(t)
    for name in funnel.GRAINS:
        want = funnel.funnel_steps(t, name)
        assert spark_rows(rows.where(F.col("grain") == name).select(*want.columns)) == spark_rows(want), name
