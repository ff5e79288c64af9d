"""Tables of the registered queries, and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.session import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; its shuffle files may go at once.

    Spark deletes the shuffle files of a finished job when the driver collects its garbage,
    which may be long after; asking for that keeps disk use at that of the largest step.
    """
    table = materialize(df, label)
    df.sparkSession._jvm.System.gc()
    return table
