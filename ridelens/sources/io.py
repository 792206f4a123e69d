"""Sources and sinks: CSV exchange files, shard merging, paged export and
materialised intermediates.

All writes are distributed (one file per task) and all reads are single
multi-path scans; nothing passes through the driver.  Intermediates go to
the shared folder named by `spark.checkpoint.dir` (only a local master may go
without one, see `session.checkpoint_dir`), so a lost executor costs a task
retry.  `drop_scratch` removes them when their readers are done.
"""

from __future__ import annotations

import csv
import functools
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridelens.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one materialisation under the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder made by `scratch_path` (and nothing outside the shared folder)."""
    if not path.startswith(checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"not a scratch folder: {path}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# The exchange dialect: quotes are doubled inside quoted fields, NULL is an
# empty field and an empty string is written "".
CSV_DIALECT = {"header": True, "dateFormat": "yyyy-MM-dd", "quote": '"', "escape": '"',
               "nullValue": "", "emptyValue": '""'}


def _one_line(df: DataFrame) -> DataFrame:
    """Strings with line breaks fail: files are read back in splits, by line."""
    def checked(f):
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, StringType):
            return c
        return F.when(c.rlike("[\\r\\n]"), F.raise_error(F.lit(
            f"line break in {f.name}: write with multi_line=True"))).otherwise(c).alias(f.name)
    return df.select(*[checked(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, max_records_per_file: int | None = None,
              multi_line: bool = False) -> str:
    """CSV with a header row.  Line breaks inside strings are an error unless
    `multi_line`, since only a reader that does not split files takes them."""
    w = (df if multi_line else _one_line(df)).write.mode("overwrite").options(**CSV_DIALECT)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.csv(path)
    return path


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType,
             multi_line: bool = False) -> DataFrame:
    """Header CSV under a fixed schema.  `enforceSchema=False` checks each
    file's header against the schema names (Spark maps CSV columns by
    position), so a shard with a different column order fails loudly instead
    of shifting values; empty fields read as NULL."""
    # the parser hands an unquoted empty field over as its null value: one that
    # no text holds keeps it apart from a quoted empty string
    return (spark.read.options(**{**CSV_DIALECT, "emptyValue": "", "nullValue": "\x01"})
            .option("enforceSchema", False)
            .option("mode", "FAILFAST").option("multiLine", multi_line)
            .schema(schema).csv(paths))


def merge_shards(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """Many exported shards as one dataset: a single scan over all paths (file
    splits become tasks), aligned by column name."""
    return read_csv(spark, paths, schema)


def merge_drifting_shards(frames: list[DataFrame]) -> DataFrame:
    """Shards whose headers drift (added/removed columns): align by name,
    missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shard_headers(spark: SparkSession, pattern: str, threads: int = 32) -> dict[tuple[str, ...], list[str]]:
    """The files that `pattern` names, by their header: only first lines are
    read, as a footer is of a Parquet file, and no data.  A file without a line
    is left out (it has no rows)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = target.getFileSystem(conf)
    files = [s.getPath() for s in fs.globStatus(target) or [] if s.isFile()]

    def header(path) -> str | None:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            fs.open(path), jvm.java.nio.charset.StandardCharsets.UTF_8))
        try:
            return reader.readLine()
        finally:
            reader.close()

    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for path, line in zip(files, pool.map(header, files)):
            if line:
                names = next(csv.reader([line.removeprefix("\ufeff")]))
                groups.setdefault(tuple(names), []).append(path.toString())
    return groups


def merge_by_header(spark: SparkSession, pattern: str, schema: StructType,
                    multi_line: bool = False) -> DataFrame:
    """All shards that `pattern` names as one dataset, whatever their headers:
    columns are found by name in any order, those a shard lacks are NULL, and
    those that `schema` does not know are kept as strings after its own.

    Shards of one header are one scan, so the plan has a branch for each header
    and not for each file.  Names differing in case only, or twice in one header,
    are an error."""
    groups = shard_headers(spark, pattern)
    known = {f.name: f for f in schema.fields}
    for names in groups:
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"a header names a column twice: {','.join(names)}")
    extra = sorted({n for names in groups for n in names} - set(known))
    target = StructType([*schema.fields, *[StructField(n, StringType()) for n in extra]])
    if len({n.lower() for n in target.names}) < len(target.names):
        raise ValueError(f"headers differ in case only: {target.names}")
    by_name = {f.name: f for f in target.fields}

    def aligned(names: tuple[str, ...], paths: list[str]) -> DataFrame:
        part = read_csv(spark, paths, StructType([by_name[n] for n in names]), multi_line)
        return part.select(*[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name)
                             for f in target.fields])
    parts = [aligned(names, paths) for names, paths in sorted(groups.items())]
    return functools.reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], target)


RECORD = "_rejected_record"


def read_csv_checked(spark: SparkSession, paths: str | list[str], schema: StructType,
                     required: list[str] | None = None, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows under `schema`, rejected records) of header CSV.

    Where `read_csv` fails on the first field that does not fit, this keeps such
    records: a record with too few or too many fields, a field that is no value
    of its column's type, or an empty field of a `required` column goes to the
    rejects (file, record, reason), every other one to the good rows, and none
    to both.  Both frames are one scan each of the same expression."""
    names = schema.names
    if RECORD in names:
        raise ValueError(f"the schema may not have a column {RECORD}")
    text = StructType([*[StructField(n, StringType()) for n in names], StructField(RECORD, StringType())])
    raw = (spark.read.options(**{**CSV_DIALECT, "emptyValue": "", "nullValue": "\x01"})
           .options(mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, columnPruning=False,
                    multiLine=multi_line, enforceSchema=True)
           .schema(text).csv(paths))
    field = {f.name: F.col(f"`{f.name}`") for f in schema.fields}

    def value(f):
        return field[f.name] if isinstance(f.dataType, StringType) else field[f.name].try_cast(f.dataType)
    reasons = [F.when(F.col(RECORD).isNotNull(), F.lit("number of fields"))]
    for f in schema.fields:
        if f.name in (required or []):
            reasons.append(F.when(field[f.name].isNull(), F.lit(f"{f.name}: missing")))
        if not isinstance(f.dataType, StringType):
            reasons.append(F.when(field[f.name].isNotNull() & value(f).isNull(),
                                  F.lit(f"{f.name}: no {f.dataType.simpleString()}")))
    reason = F.coalesce(*reasons)
    # a record of the right number of fields is written again from them
    record = F.coalesce(F.col(RECORD), F.to_csv(
        F.struct(*[field[n].alias(n) for n in names]),
        {k: v for k, v in CSV_DIALECT.items() if k in ("quote", "escape", "nullValue", "emptyValue")}))
    good = raw.where(reason.isNull()).select(*[value(f).alias(f.name) for f in schema.fields])
    bad = raw.where(reason.isNotNull()).select(F.col("_metadata.file_path").alias("file"), record.alias("record"),
                                               reason.alias("reason"))
    return good, bad


def number_rows(df: DataFrame, order_by: list[str], path: str, num_partitions: int | None = None) -> str:
    """Store a result with each row's position under a total order (`order_by`
    must be unique per row); NULLs sort last.  Any page is then a range of
    `_pos`, which Parquet row groups prune: one sort serves all pages.

    Nothing is sorted in one task: the data is range partitioned and sorted
    inside each partition; per-partition row counts (one row per partition)
    are prefix-summed into start offsets, and a row's position is its
    partition's start plus its index there.  The sorted partitions are
    checkpointed (reliably, to the shared folder) so that counts and positions
    read the very same ones: range bounds come from sampling, and a
    recomputation could draw different ones."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    cols = [F.col(c).asc_nulls_last() for c in order_by]
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_parts = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).checkpoint()
    ranged = sorted_parts.withColumns({"_part": F.spark_partition_id(),
                                       "_mono": F.monotonically_increasing_id()})
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    # `starts` has exactly one row per partition, a bound fixed by `parts`
    position = (F.col("_start") + F.col("_mono")
                - F.shiftleft(F.col("_part").cast("bigint"), 33))
    numbered = (ranged.join(F.broadcast(starts), "_part").withColumn("_pos", position)
                .drop("_part", "_mono", "_start"))
    numbered.write.mode("overwrite").parquet(path)
    return path


def read_page(spark: SparkSession, path: str, page: int, page_size: int) -> DataFrame:
    """One page of a numbered result, in order: a pruned scan."""
    lo = page * page_size
    return (spark.read.parquet(path).where((F.col("_pos") >= lo) & (F.col("_pos") < lo + page_size))
            .orderBy("_pos").drop("_pos"))


def read_all_pages(spark: SparkSession, path: str, page_size: int) -> DataFrame:
    """Every row of a numbered result with its page."""
    return spark.read.parquet(path).withColumn("page", F.floor(F.col("_pos") / page_size).cast("bigint")).drop("_pos")


def export_page(df: DataFrame, order_by: list[str], page: int, page_size: int,
                num_partitions: int | None = None) -> DataFrame:
    """One page of a result that is not numbered yet.  This runs the numbering;
    for more than one page call `number_rows` once and `read_page` for each."""
    spark = df.sparkSession
    return read_page(spark, number_rows(df, order_by, scratch_path(spark, "numbered"), num_partitions),
                     page, page_size)


def export_all_pages(df: DataFrame, path: str, order_by: list[str], page_size: int,
                     num_partitions: int | None = None) -> str:
    """The whole result, in order, as CSV files that are its pages: in the order
    of their names, file k holds the rows from k * page_size on, and only the
    last one may have fewer than `page_size`.

    Positions come from one distributed numbering.  Task p is then given the
    p-th run of whole pages (a row's task is its position div the run's length),
    sorts it and starts a file every `page_size` rows, so no file ends where a
    range partition happens to end."""
    spark = df.sparkSession
    numbers = scratch_path(spark, "numbered")
    number_rows(df, order_by, numbers, num_partitions)
    numbered = spark.read.parquet(numbers)
    pages = -(-numbered.count() // page_size)
    per_task = max(1, -(-pages // (num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))))
    task = F.floor(F.col("_pos") / (page_size * per_task)).cast("int")
    runs = numbered.repartitionById(max(1, -(-pages // per_task)), task).sortWithinPartitions("_pos")
    write_csv(runs.drop("_pos"), path, max_records_per_file=page_size)
    drop_scratch(spark, numbers)  # its only reader is done
    return path


_PAGE_FILE = r"part-(\d+)-.*-c(\d+)\.csv"


def read_page_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The pages written by `export_all_pages` with the `page` each row is on.
    Every task but the last writes the same number of files, so a file's page
    follows from its name."""
    rows = read_csv(spark, path, schema)
    files = [re.search(_PAGE_FILE, name) for name in rows.inputFiles()]
    per_task = 1 + max((int(f[2]) for f in files if f), default=0)
    name = F.col("_metadata.file_name")
    task, file = (F.regexp_extract(name, _PAGE_FILE, k).cast("bigint") for k in (1, 2))
    return rows.select("*", (task * per_task + file).alias("page"))


def store_partitioned(df: DataFrame, path: str, partition_by: list[str], sort_by: str | None = None) -> str:
    """Persist a dataset as Parquet partitioned on low-cardinality filter keys
    (e.g. `funnel_step`).  Rows meet by key and month of the date `sort_by`
    before the write, and are sorted by it, so each task writes few files whose
    row groups the date predicates prune.  Adaptive execution splits a large key
    and month over several tasks."""
    if partition_by:
        # the hint takes names only
        months = {"_store_month": F.trunc(sort_by, "month")} if sort_by else {}
        df = df.withColumns(months).hint("rebalance", *partition_by, *months)
        df = df.sortWithinPartitions(*partition_by, *([sort_by] if sort_by else [])).drop(*months)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def interleaved(ranks: list[Column], bits: int) -> Column:
    """One number from the bits of several ranks, highest bits first (Z-order)."""
    parts = [F.shiftleft(F.shiftright(r, b).bitwiseAND(1), b * len(ranks) + k)
             for b in range(bits) for k, r in enumerate(ranks)]
    return functools.reduce(Column.bitwiseOR, parts)


def store_clustered(df: DataFrame, path: str, columns: list[str], bits: int = 5,
                    num_partitions: int | None = None, row_group_bytes: int | None = None) -> str:
    """Persist a dataset so that bounds on any of several numeric `columns` prune
    row groups: rows lie in the Z-order of the columns' quantile ranks (2^bits
    each, nulls lowest), so a row group is narrow in all of them and not only in
    a leading sort column.

    The driver gets 2^bits - 1 cut points a column.  Rows of one Z cell are spread
    by the columns and a digest of the row, so a cell with a third of all rows
    is no single task, unless those rows are equal."""
    if not 0 < bits * len(columns) < 63:
        raise ValueError("bits * columns must fit a long")
    spark = df.sparkSession
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    shares = [k / 2 ** bits for k in range(1, 2 ** bits)]
    cuts = doubles.approxQuantile(doubles.columns, shares, 0.2 / 2 ** bits)

    def rank(c: str, points: list[float]) -> Column:
        value = F.col(f"`{c}`").cast("double")
        at_most = [F.when(value >= p, 1).otherwise(0) for p in sorted(set(points))]
        return functools.reduce(Column.__add__, at_most, F.lit(0)).cast("bigint")
    z = interleaved([rank(c, p) for c, p in zip(columns, cuts)], bits)
    keyed = df.withColumns({"_z": z, "_z_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    order = ["_z", *[f"`{c}`" for c in columns], "_z_row"]
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = (keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_z", "_z_row")
         .write.mode("errorifexists"))
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing to the shared checkpoint folder and reading back.

    Unlike a local checkpoint, the data survives the loss of the executor
    that computed it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
