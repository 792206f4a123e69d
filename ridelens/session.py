"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Timestamps in the sources are zone-less, and
# the session zone is pinned so hour/day extraction never depends on the host.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Coalesce shuffle partitions to the advisory size rather than keeping
    # the default parallelism (recommended for shared clusters).
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # Let AQE swap a sort-merge join for a shuffled hash join when every
    # post-shuffle partition is below this size (checked at runtime, so a
    # skewed or large join keeps sort-merge and skew splitting).
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ridelens", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session instead and
    let its own `spark.sql.shuffle.partitions` and checkpoint folder apply."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediates.

    Named by `spark.checkpoint.dir`, or set on the context by the user (never
    overridden).  Only a local master, where driver and executors are one
    process, falls back to a temporary folder; on a cluster an unnamed folder
    is an error, since executors would write to disks nobody else reads."""
    sc = spark.sparkContext
    given = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not (named or given):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="ridelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not given:
        sc.setCheckpointDir(named)
    return named or given
