"""Sources and sinks: stored dashboard inputs, paged export, shard merging."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, spark_rows
from ridelens.operators import funnel
from ridelens.plans import panels
from ridelens.plans.exchange import DAILY_USER_ORDER
from ridelens.plans.store import read_store, write_store
from ridelens.sources import io
from ridelens.sources.adapter import from_driver_tables


def test_store_round_trip_and_partition_pruning(spark):
    t = from_driver_tables(spark, SF_SMALL)
    root = io.scratch_path(spark, "store")
    write_store(t, root, ["funnel_daily", "funnel_daily_user"])
    stored = read_store(spark, root, ["funnel_daily", "funnel_daily_user"])
    assert spark_rows(stored["funnel_daily"]) == spark_rows(funnel.funnel_daily(t))
    panel = panels.panel_rides_requested(stored["funnel_daily"], start_date="1995-01-01")
    assert spark_rows(panel) == spark_rows(
        panels.panel_rides_requested(funnel.funnel_daily(t), start_date="1995-01-01"))
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(funnel_step" in plan
    assert "PushedFilters" in plan and "daily_date" in plan


def test_export_all_pages_is_ordered_and_bounded(spark):
    t = from_driver_tables(spark, SF_SMALL)
    df = funnel.funnel_daily_user(t)
    path = io.export_all_pages(df, io.scratch_path(spark, "pages"), DAILY_USER_ORDER, 300)
    files = sorted(glob.glob(os.path.join(path, "part-*.csv")))
    assert len(files) > 1
    back = io.read_csv(spark, [path], df.schema)
    assert back.count() == df.count()
    sizes = [sum(1 for _ in open(f)) - 1 for f in files]
    assert max(sizes) <= 300
    # files in name order are one global order
    rows = []
    for f in files:
        part = io.read_csv(spark, [f], df.schema).collect()
        rows.extend(part)
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in DAILY_USER_ORDER]).collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in ordered]
    second = io.export_page(df, DAILY_USER_ORDER, 1, 300).collect()
    assert [tuple(r) for r in second] == [tuple(r) for r in rows[300:600]]


@pytest.mark.parametrize("rows,page_size,parts", [(1000, 90, 4), (1000, 250, 8), (7, 3, 5), (10, 10, 3), (10, 1, 4),
                                                  (11, 100, 4), (0, 5, 2)])
def test_page_files_hold_exactly_a_page(spark, rows, page_size, parts):
    """Sizes that do and do not divide the rows or the tasks; many keys share a
    leading value, so range partitions are uneven."""
    df = spark.range(rows).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("b"),
                                  F.col("id").alias("c")).repartition(3)
    path = io.export_all_pages(df, io.scratch_path(spark, "pages"), ["a", "b", "c"], page_size, parts)
    files = sorted(f for f in glob.glob(os.path.join(path, "part-*.csv")) if sum(1 for _ in open(f)) > 1)
    assert [sum(1 for _ in open(f)) - 1 for f in files] == \
        [page_size] * (rows // page_size) + [rows % page_size] * (rows % page_size > 0)
    order = [F.col(c).asc_nulls_last() for c in ("a", "b", "c")]
    want = [(r["a"], r["b"], r["c"], k // page_size) for k, r in enumerate(df.orderBy(*order).collect())]
    got = io.read_page_files(spark, path, df.schema).orderBy("page", *order).collect()
    assert [tuple(r) for r in got] == want


def test_merge_drifting_shards(spark):
    a = spark.createDataFrame([(1, "x")], "user_id bigint, platform string")
    b = spark.createDataFrame([("ios", 2, 7)], "platform string, user_id bigint, rides bigint")
    merged = io.merge_drifting_shards([a, b])
    got = sorted((r.user_id, r.platform, r.rides) for r in merged.collect())
    assert got == [(1, "x", None), (2, "ios", 7)]


def test_csv_header_mismatch_fails(spark):
    df = spark.createDataFrame([(1, "a")], "user_id bigint, platform string")
    path = io.write_csv(df, io.scratch_path(spark, "hdr"))
    swapped = spark.createDataFrame([], "platform string, user_id bigint").schema
    try:
        io.read_csv(spark, [path], swapped).collect()
    except Exception as exc:  # header names are checked against the schema
        assert "header" in str(exc).lower() or "csv" in str(exc).lower()
    else:
        raise AssertionError("mismatched CSV header was accepted")


def test_materialize_cuts_lineage(spark):
    t = from_driver_tables(spark, SF_SMALL)
    df = funnel.funnel_by_platform(t)
    m = io.materialize(df, "q01")
    assert "Scan parquet" in m._jdf.queryExecution().executedPlan().toString()
    assert spark_rows(m) == spark_rows(df)
    assert m.where(F.col("funnel_step") == 1).count() > 0


@pytest.mark.parametrize("page,size", [(0, 700), (3, 700), (19, 700), (40, 700), (2, 2500)])
def test_export_page_equals_brute_force(spark, page, size):
    t = from_driver_tables(spark, SF_SMALL)
    df = funnel.funnel_daily_user(t)
    everything = df.orderBy(*[F.col(c).asc_nulls_last() for c in DAILY_USER_ORDER]).collect()
    got = io.export_page(df, DAILY_USER_ORDER, page, size).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in everything[page * size:(page + 1) * size]]


def test_five_tables_round_trip_through_csv(spark):
    from ridelens.operators.funnel import funnel_by_age_platform
    from ridelens.sources.tables import TABLE_NAMES, read_csv_tables
    t = from_driver_tables(spark, SF_SMALL)
    root = io.scratch_path(spark, "tables_csv")
    for name, df in t.as_dict().items():
        io.write_csv(df, f"{root}/{name}")
    back = read_csv_tables(spark, root)
    for name in TABLE_NAMES:
        assert spark_rows(getattr(back, name)) == spark_rows(getattr(t, name)), name
    assert spark_rows(funnel_by_age_platform(back)) == spark_rows(funnel_by_age_platform(t))


def test_five_tables_from_parquet(spark):
    from ridelens.operators.charges import user_declines
    from ridelens.sources.tables import TABLE_NAMES, read_parquet_tables
    t = from_driver_tables(spark, SF_SMALL)
    root = io.scratch_path(spark, "tables_parquet")
    for name, df in t.as_dict().items():
        df.write.parquet(f"{root}/{name}")
    back = read_parquet_tables(spark, root)
    for name in TABLE_NAMES:
        assert spark_rows(getattr(back, name)) == spark_rows(getattr(t, name)), name
    assert spark_rows(user_declines(back)) == spark_rows(user_declines(t))
    plan = user_declines(back)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ride_id:bigint,user_id:bigint,driver_id:bigint>" in plan


def test_store_splits_a_hot_month(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        df = spark.range(0, 200_000, 1, 8).selectExpr(
            "1 AS step", "date_add(date'2021-03-01', cast(id % 31 AS int)) AS day", "uuid() AS user")
        path = io.store_partitioned(df, str(tmp_path / "hot"), ["step"], "day")
    finally:
        spark.conf.set(size, before)
    assert len(list((tmp_path / "hot" / "step=1").glob("*.parquet"))) > 4
    assert spark.read.parquet(path).agg({"user": "count"}).first()[0] == 200_000


def _files(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder / "*.csv")


def test_merge_by_header(spark, tmp_path):
    """Any column order, missing and unknown columns, quoted names, empty files;
    one scan for each header."""
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("user_id bigint, platform string, rides int")
    pattern = _files(tmp_path / "a", one="user_id,platform,rides\n1,ios,3\n2,,\n", two="rides,user_id,platform\n7,3,web\n",
                     three="user_id,platform,rides\n4,web,1\n", four="platform,user_id\nios,5\n", five="",
                     six='user_id,"a note"\n6,"x, y"\n', seven="user_id,platform,rides\n")
    df = io.merge_by_header(spark, pattern, schema)
    assert df.columns == ["user_id", "platform", "rides", "a note"]
    assert sorted(map(tuple, df.collect())) == [
        (1, "ios", 3, None), (2, None, None, None), (3, "web", 7, None), (4, "web", 1, None), (5, "ios", None, None),
        (6, None, None, "x, y")]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 4
    assert io.merge_by_header(spark, str(tmp_path / "none" / "*.csv"), schema).collect() == []
    with pytest.raises(ValueError, match="twice"):
        io.merge_by_header(spark, _files(tmp_path / "b", one="user_id,user_id\n1,2\n"), schema)
    with pytest.raises(ValueError, match="case"):
        io.merge_by_header(spark, _files(tmp_path / "c", one="User_Id\n1\n"), schema)


def test_rejected_records_keep_file_and_reason(spark, tmp_path):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("id bigint, day date, name string, amount double")
    pattern = _files(tmp_path / "a", one='id,day,name,amount\n1,2021-01-02,"a, b",1.5\nx,2021-01-02,c,2\n3,soon,"d, ""e""",2\n',
                     two="id,day,name,amount\n4,2021-01-04\n5,2021-01-05,f,1,9\n,2021-01-06,g,1\n7,,,\n8,2021-01-08,h,much\n")
    good, bad = io.read_csv_checked(spark, pattern, schema, required=["id"])
    assert good.schema == schema
    assert sorted((r["id"], str(r["day"]), r["name"], r["amount"]) for r in good.collect()) == [
        (1, "2021-01-02", "a, b", 1.5), (7, "None", None, None)]
    got = sorted((os.path.basename(r["file"]), r["reason"], r["record"]) for r in bad.collect())
    assert got == sorted([
        ("one.csv", "id: no bigint", "x,2021-01-02,c,2"), ("one.csv", "day: no date", '3,soon,"d, ""e""",2'),
        ("two.csv", "number of fields", "4,2021-01-04"), ("two.csv", "number of fields", "5,2021-01-05,f,1,9"),
        ("two.csv", "id: missing", ",2021-01-06,g,1"), ("two.csv", "amount: no double", "8,2021-01-08,h,much")])
    assert good.where("id > 5").count() == 1 and bad.select("reason").count() == 6  # narrower reads agree
