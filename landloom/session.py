"""Session helpers: recommended settings and reliable checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "landloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taken from ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where driver and
    executors share one machine; on a cluster a missing setting is an error,
    because a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="landloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The columns are named anew, so the result can be joined with anything
    derived from ``df`` without sharing column references. Spark goes on
    estimating the result by the files it came from, which says little after
    rows were expanded; the hint keeps joins from sending it through the driver.
    """
    ensure_checkpoint_dir(df.sparkSession)
    saved = df.checkpoint(eager=True)
    return shuffled(saved.select(*[F.col(c).alias(c) for c in saved.columns]))


def measured_broadcasts(spark: SparkSession) -> None:
    """Let joins be broadcast by the size that adaptive execution measured, not by an estimate.

    The estimate of rows made from a small file stays that of the file, however
    much was made of them; a table taken for small then goes through the driver.
    """
    limit = "spark.sql.autoBroadcastJoinThreshold"
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(limit) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(limit))
        spark.conf.set(limit, "-1")


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by shuffles and not broadcast, whatever its estimated size.

    The hint reaches the next join through projections, filters and
    aggregates, but not through a union or another join.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` over all task slots.

    Adaptive execution merges shuffle partitions by size in bytes; grouped
    Python work is heavy per byte, so it asks for its partitions explicitly.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that a row computes once.

    Filters on a computed column would be pushed below it, and below a
    repartitioning, with its whole expression repeated for each use; they stay
    above a generator, here of one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
