"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lobbylens") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        # The JVM does not compile methods above 8000 bytes; wide stages do better split up.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOBBYLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites of column expressions cost more than the expressions themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a session on one machine without the setting gets a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by the cluster")
        named = tempfile.mkdtemp(prefix="lobbylens-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark)}/lobbylens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder, cut its lineage and read it back.

    For narrow results that several scans read: the plan behind them runs once, the planner
    knows their size, and a lost executor costs a re-read and not a re-run.
    """
    path = run_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
