"""Versioned datasets: published at once, refreshed by period, with statistics.

A dataset is a folder of immutable versions and numbered manifests:

    <root>/version=<id>/<partition folders>/...parquet
    <root>/_statistics/version=<id>/...parquet
    <root>/_manifests/<number>.json

A manifest names, for every partition, the version that holds it; the one with
the highest number is current.  A manifest is written under another name and
then renamed, and a rename never replaces an existing one: readers see all of a
publication or nothing of it, a job that fails before the rename leaves the
dataset as it was, and of two writers that started from the same manifest the
second one fails.  Readers resolve the manifest once, so a frame opened before a
refresh keeps reading its own files until `expire` drops them.

The manifest has one entry per partition (funnel steps x periods), a number
bounded by the calendar and not by the data.

Edge cases: rows without a date form a period of their own; an empty dataset is
published without partitions and read as an empty frame of its schema.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructField, StructType

PERIOD, VERSION = "store_period", "version"
NO_PERIOD = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of a null partition value


class Conflict(RuntimeError):
    """Another writer published first."""


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/_manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def _read_manifest(spark: SparkSession, root: str, number: int) -> dict:
    fs, path = _fs(spark, f"{root}/_manifests/{number:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the current manifest."""
    numbers = _manifests(spark, root.rstrip("/"))
    if not numbers:
        raise FileNotFoundError(f"no dataset published under {root}")
    return numbers[-1], _read_manifest(spark, root.rstrip("/"), numbers[-1])


def _commit(spark: SparkSession, root: str, number: int, manifest: dict) -> None:
    """Make `manifest` the current one, if nobody has published that number."""
    jvm = spark.sparkContext._jvm
    fs, written = _fs(spark, f"{root}/_manifests/.{uuid.uuid4().hex}")
    _, final = _fs(spark, f"{root}/_manifests/{number:012d}.json")
    stream = fs.create(written, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    if fs.exists(final):
        raise Conflict(f"{root}: version {number} has been published by another writer")
    files.rename(written, final, keep)


def _partitions(spark: SparkSession, root: str, version: str, depth: int) -> list[str]:
    """The partition folders that a version wrote, below its own."""
    if not depth:
        return [""]
    fs, pattern = _fs(spark, "/".join([f"{root}/{version}", *["*=*"] * depth]))
    found = fs.globStatus(pattern) or []
    return sorted("/".join(s.getPath().toString().rsplit("/", depth)[1:]) for s in found)


def _write(df: DataFrame, root: str, manifest: dict) -> tuple[str, list[str]]:
    """A new version with the rows of `df`; returns its folder and partitions."""
    spark = df.sparkSession
    keys, date, period = manifest["keys"], manifest["date"], manifest["period"]
    # led by a letter: Spark takes a folder value of digits, or like 12e5, for a number
    version = f"{VERSION}=v{uuid.uuid4().hex[:12]}"
    if period:
        df = df.withColumn(PERIOD, F.trunc(date, period))
    by = [*keys, *([PERIOD] if period else [])]
    if by:
        # a large key and period is split over several tasks by adaptive execution
        df = df.hint("rebalance", *by).sortWithinPartitions(*by, *([date] if date else []))
    df.write.mode("errorifexists").partitionBy(*by).parquet(f"{root}/{version}")
    written = _partitions(spark, root, version, len(by))
    new = {**manifest, "written": {version: len(written)}}
    _statistics(_open(spark, root, new, {p: version for p in written}), by, manifest["domains"]).write.parquet(
        f"{root}/_statistics/{version}")
    return version, written


def _statistics(df: DataFrame, by: list[str], domains: list[str]) -> DataFrame:
    """One row per partition: its rows, the least and largest value of each number
    and date, and the distinct values of each column in `domains`, which are of
    few values by their nature (ages, platforms)."""
    measured = [f.name for f in df.schema.fields
                if f.name not in (*by, VERSION) and isinstance(f.dataType, (NumericType, DateType))]
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[agg(f"`{c}`").alias(f"{name}_{c}") for c in measured for name, agg in (("min", F.min), ("max", F.max))],
        *[F.collect_set(c).alias(f"values_{c}") for c in domains])


def publish(df: DataFrame, root: str, keys: list[str] | None = None, date: str | None = None,
            period: str | None = None, domains: list[str] | None = None) -> str:
    """Replace a dataset (or make its first version) at once.

    keys: partition columns of few values; date: rows are sorted by it within a
    partition; period ("month", "quarter", "year"): also partitioned by the date's
    period, so `refresh` can replace single ones; domains: columns whose values
    the statistics list."""
    spark, root = df.sparkSession, root.rstrip("/")
    number = (_manifests(spark, root) or [0])[-1]
    if period and not date:
        raise ValueError("a period needs a date column")
    manifest = {"keys": list(keys or []), "date": date, "period": period, "domains": list(domains or []),
                "schema": df.schema.json()}
    version, written = _write(df, root, manifest)
    _commit(spark, root, number + 1, {**manifest, "written": {version: len(written)},
                                      "partitions": {p: version for p in written}})
    return root


def _period_of(partition: str) -> str:
    return partition.rsplit(f"{PERIOD}=", 1)[1]


def _first_of_period(day: dt.date, period: str) -> dt.date:
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    return day.replace(month=(day.month - 1) // months * months + 1, day=1)


def _after_period(day: dt.date, period: str) -> dt.date:
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    ahead = _first_of_period(day, period).month - 1 + months
    return dt.date(day.year + ahead // 12, ahead % 12 + 1, 1)


def refresh(df: DataFrame, root: str, start: dt.date, end: dt.date | None = None) -> list[str]:
    """Bring the periods that touch `start`..`end` (open: all later ones) up to
    date with `df`, the dataset as it is now, and the rows without a date with
    them; returns the partitions written.  `df` is lazy and only asked for those
    periods, so the date bounds reach its scans.  All other partitions keep
    their files; partitions of these periods that `df` has no rows for are gone."""
    spark, root = df.sparkSession, root.rstrip("/")
    number, manifest = current(spark, root)
    if not manifest["period"]:
        raise ValueError(f"{root} was published without periods")
    if df.schema.names != StructType.fromJson(json.loads(manifest["schema"])).names:
        raise ValueError(f"columns differ from those of {root}")
    lo = _first_of_period(start, manifest["period"])
    hi = _after_period(end, manifest["period"]) if end else None
    date = F.col(manifest["date"])
    dated = df.where(date >= F.lit(lo) if hi is None else (date >= F.lit(lo)) & (date < F.lit(hi)))
    # apart from the undated rows, so that the bounds can pass outer joins
    version, written = _write(dated.unionByName(df.where(date.isNull())), root, manifest)

    def replaced(partition: str) -> bool:
        value = _period_of(partition)
        return value == NO_PERIOD or (value >= lo.isoformat() and (hi is None or value < hi.isoformat()))
    kept = {p: v for p, v in manifest["partitions"].items() if not replaced(p)}
    sizes = {v: n for v, n in manifest["written"].items() if v in kept.values()}
    _commit(spark, root, number + 1, {**manifest, "written": {**sizes, version: len(written)},
                                      "partitions": {**kept, **{p: version for p in written}}})
    return written


def _open(spark: SparkSession, root: str, manifest: dict, partitions: dict[str, str]) -> DataFrame:
    declared = StructType.fromJson(json.loads(manifest["schema"]))
    extra = [StructField(PERIOD, DateType())] if manifest["period"] else []
    schema = StructType([*declared.fields, *extra])
    if not partitions:
        return spark.createDataFrame([], schema)
    held = Counter(partitions.values())
    # a version all of whose partitions are current is one folder to list
    whole = {v for v, n in held.items() if n == manifest["written"][v]}
    paths = sorted({f"{root}/{v}" if v in whole else f"{root}/{v}/{p}" for p, v in partitions.items()})
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The current version; filters on its keys prune partitions, those on its
    date row groups."""
    root = root.rstrip("/")
    _, manifest = current(spark, root)
    columns = StructType.fromJson(json.loads(manifest["schema"])).names
    return _open(spark, root, manifest, manifest["partitions"]).select(*[F.col(f"`{c}`") for c in columns])


def statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row per partition of the current version, without its data being read:
    keys, period, n_rows, min_*, max_* and values_* (see `publish`)."""
    root = root.rstrip("/")
    _, manifest = current(spark, root)
    live = manifest["partitions"]
    by = [*manifest["keys"], *([PERIOD] if manifest["period"] else [])]
    versions = sorted(set(live.values()))
    if not versions:
        return _statistics(_open(spark, root, manifest, {}), by, manifest["domains"]).limit(0)
    stats = (spark.read.option("basePath", f"{root}/_statistics")
             .parquet(*[f"{root}/_statistics/{v}" for v in versions]).withColumn(VERSION, F.col(VERSION).cast("string")))
    if not by:
        return stats.drop(VERSION)
    # a version's partitions that a later one has replaced are no longer in the manifest
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(NO_PERIOD)))
                                for c in by])
    entries = [f"{v.split('=', 1)[1]}/{p}" for p, v in live.items()]
    return stats.where(F.concat_ws("/", VERSION, folder).isin(entries)).drop(VERSION)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop the manifests before the last `keep` and the versions that only they
    name; returns the versions dropped.  Readers of those manifests must be done
    and no writer at work."""
    root = root.rstrip("/")
    numbers = _manifests(spark, root)
    old, kept = numbers[:-max(1, keep)], numbers[-max(1, keep):]
    live = {v for n in kept for v in _read_manifest(spark, root, n)["partitions"].values()}
    fs, folder = _fs(spark, root)
    gone = sorted({v for n in old for v in _read_manifest(spark, root, n)["partitions"].values()} - live)
    for n in old:  # first the names, so that nobody opens a version half dropped
        fs.delete(_fs(spark, f"{root}/_manifests/{n:012d}.json")[1], False)
    for v in gone:
        fs.delete(_fs(spark, f"{root}/{v}")[1], True)
        fs.delete(_fs(spark, f"{root}/_statistics/{v}")[1], True)
    return gone
