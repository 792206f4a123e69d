"""Readers and writers: dialect, strictness, time zones, the shared folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from ridelens import session
from ridelens.sources import io, tables
from ridelens.sources.adapter import from_driver_tables
from ridelens.sources.schemas import TABLE_SCHEMAS


def test_csv_dialect_round_trip(spark):
    rows = [(1, 'a"b,c'), (2, ""), (3, None), (4, "é, x"), (5, '"')]
    df = spark.createDataFrame(rows, "k bigint, s string")
    path = io.write_csv(df, io.scratch_path(spark, "dialect"))
    assert sorted(map(tuple, io.read_csv(spark, path, df.schema).collect())) == rows


def test_doubled_quotes_of_other_exporters(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('k,s\n1,"a""b,c"\n2,\n')
    got = io.read_csv(spark, str(f), spark.createDataFrame([], "k bigint, s string").schema).collect()
    assert sorted(map(tuple, got)) == [(1, 'a"b,c'), (2, None)]


def test_line_breaks_are_refused_or_read_whole(spark):
    df = spark.createDataFrame([(1, "a\nb")], "k bigint, s string")
    with pytest.raises(Exception, match="line break"):
        io.write_csv(df, io.scratch_path(spark, "breaks"))
    path = io.write_csv(df, io.scratch_path(spark, "breaks"), multi_line=True)
    assert [tuple(r) for r in io.read_csv(spark, path, df.schema, multi_line=True).collect()] == [(1, "a\nb")]


@pytest.mark.parametrize("line", ['x3,a,Approved', '3,"1,200.50",Approved'])
def test_bad_fields_fail_instead_of_becoming_null(spark, tmp_path, line):
    root = tmp_path / "transactions"
    root.mkdir()
    (root / "a.csv").write_text(f"ride_id,purchase_amount_usd,charge_status\n{line}\n")
    with pytest.raises(Exception):
        tables.read_csv_tables(spark, str(tmp_path)).transactions.collect()


def test_tables_are_lazy(spark, tmp_path):
    t = tables.read_parquet_tables(spark, str(tmp_path / "nothing-here"))
    assert set(TABLE_SCHEMAS) == set(tables.TABLE_NAMES) and t is not None


def test_zone_aware_times_are_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT 1L AS ride_id, 1L AS user_id, 1L AS driver_id, "
                   "timestamp_seconds(1609488000) AS request_ts, "  # 2021-01-01 08:00 UTC
                   "timestamp_seconds(1609488000) AS dropoff_ts, timestamp_seconds(1609488000) AS cancel_ts")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = tables.conform(df, "ride_requests").first()["request_ts"]
            assert got == dt.datetime(2021, 1, 1, 8), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_checkpoint_folder_is_respected(spark, tmp_path, monkeypatch):
    given = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(spark) == named
    assert spark.sparkContext.getCheckpointDir() == given or given is None
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    mine = spark.sparkContext.getCheckpointDir()
    session.checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == mine


def test_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_scratch_is_removed_only_inside_the_shared_folder(spark, tmp_path):
    path = io.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    io.drop_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        io.drop_scratch(spark, str(tmp_path))


def test_no_order_is_left_out(spark):
    t = from_driver_tables(spark, SF_SMALL)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert t.ride_requests.count() == orders.count()
    unknown = t.ride_requests.join(t.signups, "user_id", "left_anti")
    assert unknown.count() > 0
    assert t.signups.join(t.ride_requests, "user_id", "left_anti").count() > 0


def test_pages_come_from_one_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    path = io.number_rows(df, ["k"], io.scratch_path(spark, "pages"), 5)
    for page in (0, 3, 9, 10):
        got = [r["k"] for r in io.read_page(spark, path, page, 100).collect()]
        assert got == list(range(1000))[page * 100:(page + 1) * 100]
    plan = io.read_page(spark, path, 3, 100)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_pos,300)" in plan.replace(" ", "")
    everything = io.read_all_pages(spark, path, 100).collect()
    assert all(r["page"] == r["k"] // 100 for r in everything) and len(everything) == 1000
