"""Reshaping kit for dashboard datasets: dense segment grid, wide <-> long,
fixed-width histogram, label building and step relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Display names of the funnel steps (fixed values of the dashboard).
STEP_LABELS = {
    "downloads": "Downloads",
    "signups": "Signups",
    "rides_requested": "Rides Requested",
    "rides_completed": "Rides Completed",
}


def relabel_steps(col: str = "funnel_name") -> Column:
    """Step name -> display name; unknown names pass through unchanged."""
    mapping = F.create_map(*[F.lit(x) for kv in STEP_LABELS.items() for x in kv])
    return F.coalesce(mapping[F.col(col)], F.col(col))


def dense_grid(cells: DataFrame, row_key: str, col_key: str,
               fill: dict[str, object]) -> DataFrame:
    """Every (row_key, col_key) pair whose row value and column value each
    occur in `cells`, with measures taken from `cells` or filled.

    `cells` is already aggregated to one row per present pair, so it holds at
    most (#row values x #column values) rows -- a handful of age ranges times
    platforms.  One pass: fold each row value's cells into a list (NULL keys included), gather the
    column values of all rows with a window over those few folded rows, and
    explode.  No cross product and no second evaluation of `cells`."""
    measures = [c for c in cells.columns if c not in (row_key, col_key)]
    folded = (cells.groupBy(row_key)
              .agg(F.collect_list(F.struct(F.col(col_key).alias("key"), *measures)).alias("_cells")))
    everything = Window.partitionBy()
    all_cols = F.array_sort(F.array_distinct(F.flatten(
        F.collect_list(F.col("_cells")["key"]).over(everything))))
    own = F.get(F.filter("_cells", lambda c: c["key"].eqNullSafe(F.col(col_key))), F.lit(0))
    out = (folded.withColumn("_all", all_cols)
           .select(row_key, "_cells", F.explode("_all").alias(col_key))
           .select(row_key, col_key, own.alias("_own"))
           .select(row_key, col_key, *[F.col("_own")[m].alias(m) for m in measures]))
    for name, value in fill.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def segment_label(*cols: str, sep: str = " - ") -> Column:
    return F.concat_ws(sep, *[F.col(c) for c in cols])


def to_long(df: DataFrame, keys: list[str], measures: dict[str, str],
            name_col: str = "measure", value_col: str = "value") -> DataFrame:
    """Wide -> long: each measure column becomes rows (measure label, value).

    `measures` maps column -> display label; values are cast to DOUBLE so
    mixed integer/decimal measures share one column."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in measures])
    long = cast.unpivot(keys, list(measures), name_col, value_col)
    labels = F.create_map(*[F.lit(x) for kv in measures.items() for x in kv])
    return long.withColumn(name_col, labels[F.col(name_col)])


def pivot_wide(df: DataFrame, index: list[str], column: str, values: list[str],
               value_col: str, other: str = "other") -> DataFrame:
    """Long -> wide over a given list of column values (no distinct scan).
    Cells of any further value, NULL included, are summed into the column
    `other`, so no row is lost."""
    known = F.when(F.col(column).isin(values), F.col(column)).otherwise(F.lit(other))
    return (df.withColumn(column, known).groupBy(*index)
            .pivot(column, [*values, other]).agg(F.sum(value_col)))


def histogram(df: DataFrame, value_col: str, id_col: str, width: int, bins: int) -> DataFrame:
    """Distinct ids per fixed-width bin [k*width, (k+1)*width), k < bins, and
    one open bin for all larger values; empty bins report 0.

    Counts are never negative, so every id is in one bin.  The bin table has
    `bins` + 1 rows, generated by Spark and joined on the bin index."""
    spark = df.sparkSession
    bin_of = F.least(F.floor(F.col(value_col) / width), F.lit(bins)).cast("int")
    binned = (df.where(F.col(value_col) >= 0).groupBy(bin_of.alias("bin"))
              .agg(F.count_distinct(id_col).alias("users")))
    edges = spark.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    start, end = F.col("bin") * width, (F.col("bin") + 1) * width
    last = F.col("bin") == bins
    return (edges.join(binned, "bin", "left")
            .select(start.alias("bin_start"), F.when(~last, end).alias("bin_end"),
                    F.when(last, F.concat(start.cast("string"), F.lit("+")))
                     .otherwise(F.concat_ws("-", start.cast("string"), end.cast("string"))).alias("bin_label"),
                    F.coalesce(F.col("users"), F.lit(0)).alias("users")))
