"""Z-ordered datasets: bounds on several columns prune files' row groups."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import spark_rows
from ridelens.sources import io

MINIMA = [{"a": 900}, {"b": 900}, {"c": 900}, {"a": 700, "c": 700}, {"a": 500, "b": 500, "c": 500}]


def groups_read(path, minima):
    """(row groups whose statistics allow the minima, all row groups)."""
    read = total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(k).name for k in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            total += 1
            top = {n: meta.row_group(g).column(k).statistics.max for k, n in enumerate(names) if n in minima}
            read += all(top[n] >= v for n, v in minima.items())
    return read, total


def test_every_bound_prunes(spark):
    df = spark.range(0, 64_000, 1, 4).select(
        "id", *[(F.abs(F.xxhash64(F.lit(c), "id")) % 1000).alias(c) for c in "abc"])
    path = io.store_clustered(df, io.scratch_path(spark, "z"), ["a", "b", "c"], bits=4, num_partitions=64)
    plain = io.scratch_path(spark, "plain")
    df.repartitionByRange(64, "a").write.parquet(plain)
    back = spark.read.parquet(path)
    assert back.columns == df.columns
    assert spark_rows(back.agg(F.count("id"), F.sum(F.xxhash64("*").cast("decimal(38,0)")))) == \
        spark_rows(df.agg(F.count("id"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))))
    for minima in MINIMA:
        read, total = groups_read(path, minima)
        assert total == 64 and read <= 0.55 * total, (minima, read)
    # sorted by one column, bounds on the others read everything
    assert groups_read(plain, {"b": 900}) == (64, 64)


def test_odd_values(spark):
    df = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS double), 'x'), (2, double('NaN'), 'y'), (NULL, 3.0D, NULL), "
                   "(2, double('NaN'), 'y') AS t(n, `v.w`, s)")
    path = io.store_clustered(df, io.scratch_path(spark, "z"), ["n", "v.w"], num_partitions=2)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    none = io.store_clustered(df.limit(0), io.scratch_path(spark, "z"), ["n"])
    assert spark.read.parquet(none).count() == 0
    with pytest.raises(ValueError):
        io.store_clustered(df, "unused", ["n"] * 13)
