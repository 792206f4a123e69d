"""The bundle of five source tables every operator takes as input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ridelens.sources.io import read_csv
from ridelens.sources.schemas import TABLE_SCHEMAS

TABLE_NAMES = tuple(TABLE_SCHEMAS)
Source = DataFrame | Callable[[], DataFrame]


class RideTables:
    """The five source tables.  Each may be given as a DataFrame or as a
    zero-argument function returning one; functions run on first access, so a
    query that touches one table never builds the plans of the others.

    `cells`: the stored ride cells (rides, charges, reviews) of
    `plans.ride_store`, which the operators then read instead of joining the
    ride-keyed tables."""

    __slots__ = ("_sources", "_frames", "cells")

    def __init__(self, app_downloads: Source, signups: Source, ride_requests: Source,
                 transactions: Source, reviews: Source, cells: dict[str, DataFrame] | None = None):
        self.cells = cells
        self._sources = dict(zip(TABLE_NAMES, (app_downloads, signups, ride_requests,
                                               transactions, reviews)))
        self._frames: dict[str, DataFrame] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._frames:
            src = self._sources[name]
            self._frames[name] = src if isinstance(src, DataFrame) else src()
        return self._frames[name]

    app_downloads = property(lambda self: self._get("app_downloads"))
    signups = property(lambda self: self._get("signups"))
    ride_requests = property(lambda self: self._get("ride_requests"))
    transactions = property(lambda self: self._get("transactions"))
    reviews = property(lambda self: self._get("reviews"))

    def with_cells(self, cells: dict[str, DataFrame]) -> RideTables:
        """The same tables with stored ride cells; the ride requests are then
        the rides of the store."""
        columns = [f.name for f in TABLE_SCHEMAS["ride_requests"].fields]
        return RideTables(**{**self._sources, "ride_requests": cells["rides"].select(*columns)}, cells=cells)

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: self._get(name) for name in TABLE_NAMES}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project a table of other types onto its fixed schema.  Zone-aware
    timestamps are taken as UTC, whatever the session's zone is."""
    def cast(f):
        c = F.col(f.name)
        if isinstance(f.dataType, TimestampNTZType) and isinstance(df.schema[f.name].dataType, TimestampType):
            return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast(f.dataType)).alias(f.name)
        return c.cast(f.dataType).alias(f.name)
    return df.select(*[cast(f) for f in TABLE_SCHEMAS[name].fields])


def read_parquet_tables(spark: SparkSession, root: str) -> RideTables:
    """Production layout: one Parquet dataset per table under `root`.

    The schema is declared, so no file is opened to infer it, and each table is
    built on first use; a scan reads the columns the plan uses."""
    return RideTables(*[lambda name=name: spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/{name}")
                        for name in TABLE_NAMES])


def read_csv_tables(spark: SparkSession, root: str) -> RideTables:
    """CSV exports of the five tables, with header, under the fixed schema.  A
    field that does not fit its type is an error, never a silent NULL."""
    return RideTables(*[lambda name=name: read_csv(spark, f"{root}/{name}", TABLE_SCHEMAS[name])
                        for name in TABLE_NAMES])
