"""Helpers shared by the operators: table readers, scratch folders, checked broadcasts."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.session import checkpoint_dir

# A side is broadcast only after its rows were counted and found within this bound.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, in the given types; other columns of the input
    (whatever their names) never reach the operator."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of `spark.checkpoint.dir`."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (counted, the
    count stops at the bound); otherwise as it is, for a shuffled join.  Give it
    something stored or cheap: it is read for the count and for the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for tables of very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Arrow batches small enough for very long texts, for the jobs run inside
    (a lazy frame that leaves the block is planned with the session's own)."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows),
              "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def any_columns(stage):
    """Let a stage take documents with further columns of any names: inside they
    have names of their own, so none is lost, replaced or ambiguous, and the
    result has the names and the order of the input."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in DOCUMENT_COLUMNS else f"column_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*docs.columns)
    return run
