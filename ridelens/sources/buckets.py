"""Datasets bucketed and sorted by a key, so that joins and aggregates on it
need no exchange.

Spark keeps a bucket specification in a catalog, not beside the files.  Here
each dataset folder has a small dataset beside it (`<path>-buckets`) with its key
and number of buckets, and `open_bucketed` registers the folder as an external table of the
session from it: any session, also on another cluster, reads the same files
without a metastore.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _table(path: str) -> str:
    return "ridelens_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> str:
    """Write `df` as Parquet in `buckets` files (default: the number of shuffle
    partitions), each sorted by `key`.

    Rows meet in their bucket by the hash that bucketing uses, so every task
    writes one file.  Every row of one key is in one bucket: give it rows that
    are already reduced per key."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files are not touched
    (df.repartition(n, key).write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    spark.createDataFrame([(key, n)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}-buckets")
    return path


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A dataset of `write_bucketed`, with its buckets known to the planner."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        spec = spark.read.parquet(f"{path.rstrip('/')}-buckets").first()  # one row by construction
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{spec['key']}`) "
                  f"SORTED BY (`{spec['key']}`) INTO {spec['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)
