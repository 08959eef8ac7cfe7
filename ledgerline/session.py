"""Session construction and the shared scratch folder.

Jobs never create their own session; they use ``df.sparkSession``. ``build_session`` is for
tests, the bench and the command line. ``spark.checkpoint.dir`` names a folder all executors share;
we read it from the session and only invent a local one when it is unset and the master is local.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on (UTC calendar arithmetic, runtime re-planning, skew splitting).
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    """A session with ``SESSION_DEFAULTS``. Master, memory and shuffle width are the caller's
    (``spark-submit``, the environment) unless given here."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The application's folder for checkpoints and written tables, inside the shared folder.

    Order: the SparkContext's directory, then ``spark.checkpoint.dir`` from the session config.
    With neither, a local master gets a fresh local folder (tests, laptops); on a cluster that
    would be a different disk on each machine, so it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's checkpoints and scratch tables. Call it when no DataFrame that
    reads them is needed any more; saved tables (:mod:`ledgerline.sources.tables`) stay."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerline-tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Reliable checkpoint of ``df`` into the shared ``spark.checkpoint.dir`` (one job that
    computes and writes the partitions), continuing from the files.

    Later stages, and retries after a lost executor, re-read the checkpoint instead of
    recomputing the lineage, and values derived from physical layout (row ids) are fixed once.
    (Measured faster than a Parquet round trip for these intermediate results.)"""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
