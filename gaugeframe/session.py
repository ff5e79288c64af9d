"""Session helpers and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gaugeframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="gaugeframe-")
    spark.sparkContext.setCheckpointDir(base)
    return base


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the workspace."""
    path = f"{workspace(spark).rstrip('/')}/gaugeframe-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call it when their results are stored.

    DataFrames built on them cannot be read afterwards.
    """
    released = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        released += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return released


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of recomputing, and
    later branches read only the columns they need. A summary stored before it is joined
    to the rows it came from lets the planner know its size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
