"""Persisted inputs of the dashboard.

The panels read the daily funnels and the summary results, not the raw
tables.  `write_store` joins the ride-keyed tables once (the bucketed ride
cells of `ride_store`), computes each dataset from them and publishes it as
Parquet under a shared root (the daily funnels partitioned by `funnel_step`,
the key every panel filters on first, and by month); `read_store` returns them
for the panel functions, whose step and date predicates then prune partitions
and push into the scan.  Datasets are versioned (`sources.versions`): a reader
never sees half of one, `refresh_store` replaces the months that changed, and
the statistics written along answer slider bounds and dropdowns.  Writing a
dataset also cuts its lineage, so a lost executor never re-runs the joins
behind it.  `SessionStore` is such a store for the registered
queries: written once per session and source, each dataset on first use.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridelens.operators import charges, demand, drivers, funnel, user_bitmaps
from ridelens.plans.ride_store import read_ride_cells, write_ride_cells
from ridelens.sources import io, versions
from ridelens.sources.tables import RideTables

# Unsorted builders: readers sort what they show.
STORED: dict[str, tuple[Callable[[RideTables], DataFrame], list[str]]] = {
    "funnel_daily": (funnel.daily_cells, ["funnel_step"]),
    "funnel_daily_user": (funnel.funnel_daily_user, ["funnel_step"]),
    "requests_by_hour": (demand.requests_by_hour, []),
    "rides_per_user": (demand.ride_counts, []),
    "user_ride_stats": (demand.user_ride_stats, []),
    "charge_status_stats": (charges.charge_status_stats, []),
    "user_declines": (lambda t: charges.decline_cells(t, "user_id"), []),
    "driver_declines": (lambda t: charges.decline_cells(t, "driver_id"), []),
    "driver_rating_summary": (drivers.driver_rating_summary, []),
}
# Distinct users per day cell as bitmaps over the stored numbers of the users.
USER_BITMAPS, USER_NUMBERS = "user_bitmaps", "user_numbers"
# Columns of few values by their nature: the statistics of a dataset list them.
DOMAINS = ["age_range", "platform"]


RIDE_CELLS = "ride_cells"


def write_ride_store(t: RideTables, root: str, buckets: int | None = None) -> RideTables:
    """Write the ride cells of a store; returns the tables over them."""
    path = write_ride_cells(t, f"{root.rstrip('/')}/{RIDE_CELLS}", buckets)
    return t.with_cells(read_ride_cells(t.ride_requests.sparkSession, path))


def open_ride_store(t: RideTables, root: str) -> RideTables:
    """The tables over a store's ride cells, for any operator."""
    return t.with_cells(read_ride_cells(t.signups.sparkSession, f"{root.rstrip('/')}/{RIDE_CELLS}"))


def bitmap_cells(t: RideTables, root: str) -> DataFrame:
    """The user bitmaps over the numbers in `root`, which are given once and
    then kept, so that cells written later can be merged with earlier ones; users
    that have come since get numbers above them."""
    spark = t.signups.sparkSession
    path = f"{root.rstrip('/')}/{USER_NUMBERS}"
    if io.path_exists(spark, path):
        user_bitmaps.extend_numbers(t, path)
    else:
        user_bitmaps.write_numbers(t, path)
    return user_bitmaps.user_cells(funnel.funnel_daily_user(t), spark.read.parquet(path))


def _built(t: RideTables, root: str, name: str) -> tuple[DataFrame, list[str]]:
    if name == USER_BITMAPS:
        return bitmap_cells(t, root), ["funnel_step"]
    build, keys = STORED[name]
    return build(t), keys


def write_dataset(t: RideTables, root: str, name: str, period: str = "month") -> str:
    """Publish one dataset; the dated ones by `period`."""
    df, keys = _built(t, root, name)
    return versions.publish(df, f"{root.rstrip('/')}/{name}", keys, "daily_date" if keys else None,
                            period if keys else None, [c for c in DOMAINS if c in df.columns])


def write_store(t: RideTables, root: str, names: list[str] | None = None, buckets: int | None = None,
                period: str = "month") -> dict[str, str]:
    """Persist the ride cells and, from them, the dashboard inputs; returns
    name -> path."""
    over_cells = write_ride_store(t, root, buckets)
    return {name: write_dataset(over_cells, root, name, period) for name in names or [*STORED, USER_BITMAPS]}


def refresh_store(t: RideTables, root: str, start: dt.date, end: dt.date | None = None,
                  names: list[str] | None = None) -> dict[str, list[str]]:
    """Bring a store up to date with tables whose rides changed on the days
    `start`..`end` (open: from `start` on): of the dated datasets the periods
    those days touch, of the summaries all.  Signups and downloads that are
    new must lie in these days too, as a rider's age and platform count on all
    days of that rider.  Returns name -> partitions written."""
    out = {}
    for name in names or [*STORED, USER_BITMAPS]:
        df, keys = _built(t, root, name)
        path = f"{root.rstrip('/')}/{name}"
        out[name] = versions.refresh(df, path, start, end) if keys else [write_dataset(t, root, name)]
    return out


def read_store(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: versions.read(spark, f"{root.rstrip('/')}/{name}") for name in names or [*STORED, USER_BITMAPS]}


class SessionStore:
    """A store in the session's scratch folder for each source folder, written
    when first asked for: the ride cells, then each dataset from them."""

    def __init__(self, load: Callable[[SparkSession, str], RideTables]):
        self._load = load
        self._tables: dict[tuple[str, str], tuple[str, RideTables]] = {}
        self._written: dict[tuple[str, str, str], str] = {}

    def _opened(self, spark: SparkSession, sf_dir: str) -> tuple[str, RideTables]:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in self._tables:
            root = io.scratch_path(spark, "store")
            self._tables[key] = root, write_ride_store(self._load(spark, sf_dir), root)
        return self._tables[key]

    def tables(self, spark: SparkSession, sf_dir: str) -> RideTables:
        return self._opened(spark, sf_dir)[1]

    def _path(self, spark: SparkSession, sf_dir: str, name: str) -> str:
        root, tables = self._opened(spark, sf_dir)
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in self._written:
            # never refreshed, so larger periods will do
            self._written[key] = write_dataset(tables, root, name, period="year")
        return self._written[key]

    def dataset(self, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        return versions.read(spark, self._path(spark, sf_dir, name))

    def statistics(self, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        return versions.statistics(spark, self._path(spark, sf_dir, name))
