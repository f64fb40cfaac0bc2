"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Observation, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "dialsieve") -> SparkSession:
    """Session with AQE (partition coalescing, skew joins), UTC and the UI off.

    Local masters get a shuffle width equal to the core count and a large
    driver heap (every task runs in the driver JVM).  On a cluster the master,
    memory and ``spark.sql.shuffle.partitions`` come from the deployment:
    size the latter for the largest shuffle (about its bytes / 128 MB, i.e.
    tens of thousands at 100 TB) and let AQE coalesce small stages down."""
    b = SparkSession.builder.appName(app_name)
    local = bool(master and master.startswith("local"))
    if master:
        b = b.master(master)
    if local:
        b = (b.config("spark.driver.memory", os.environ.get("DIALSIEVE_DRIVER_MEMORY", "16g"))
              .config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8)))
    elif shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings every plan of the library assumes (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system);
    only in local runs and tests, where it may be unset, is a scratch folder made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="dialsieve-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def observed(df, **figures):
    """``df`` and an Observation of aggregates that the job that writes it takes on the way.

    They stand on top of the plan, in the tasks that write: a task's figures count once, with
    its output, even where earlier stages run again after an executor was lost."""
    seen = Observation()
    return df.observe(seen, *[column.alias(name) for name, column in figures.items()]), seen


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder:
    one computation feeds several sinks, and a lost executor does not force the
    whole upstream plan to re-run."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
