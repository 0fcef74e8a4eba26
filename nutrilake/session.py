"""Spark session and shared-storage helpers.

Everything in the library is a ``DataFrame -> DataFrame`` function; this
module only builds a session suited to local tests and resolves the shared
checkpoint folder that a cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "nutrilake") -> SparkSession:
    """Session with AQE on, UI off and UTC time; settings that a cluster
    launcher already fixed (master, checkpoint dir) are left alone."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given = SparkConf()  # what spark-submit or a launcher has set
    local = (master or given.get("spark.master", "local")).startswith("local")
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
    }
    if local:  # a cluster's own sizes stand
        settings |= {"spark.sql.shuffle.partitions": os.environ.get("NUTRILAKE_SHUFFLE_PARTITIONS", "8"),
                     "spark.driver.memory": os.environ.get("NUTRILAKE_DRIVER_MEMORY", "16g")}
    settings = {k: v for k, v in settings.items() if not given.contains(k)}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _let_workers_import(sc: SparkContext) -> None:
    """Python workers look for this package where the driver has it, if it is there for them too."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    have = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*have, root])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session and used as is. Only when it is unset (local tests) is a
    fresh private folder under the system temp dir created.
    """
    sc = spark.sparkContext
    _let_workers_import(sc)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="nutrilake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used between multi-pass stages (e.g. the two probe passes of the exact
    nearest-neighbour join) so that a lost executor recomputes from the
    checkpoint, not from the source scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Dealt anew by ``keys`` to tasks of about 8,192 rows, for work that takes its time per row: a file of short rows is
    one task however long that work is. ``rows``: their number, if it is known."""
    n = df.count() if rows is None else rows
    return df.repartition(min(2000, max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 8192))), *keys)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stages whose results are checkpointed.

    It does so when the driver's references to them are collected, which on a driver with
    free memory may be long after they are of use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """Path inside the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])
