"""Joins between files, rows, predictions and held-out truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.timeparse import file_stem, ts_digits


def join_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with the ground truth of their file; the rest is dropped."""
    return predictions.join(truth, "file")


def truth_in_scope(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files the metadata knows."""
    return files.join(metadata.select("file"), "file", "left_semi")


def first_rows(indexed: DataFrame, ts: str = "ts", idx: str = "idx") -> DataFrame:
    """(digits, idx): the first row of every rendered timestamp."""
    return indexed.groupBy(ts_digits(F.col(ts)).alias("digits")).agg(F.min(idx).alias("idx"))


def join_file_to_row(files: DataFrame, indexed: DataFrame, ts: str = "ts", idx: str = "idx") -> DataFrame:
    """The row whose rendered timestamp equals the file stem, the first one if several do."""
    rows = first_rows(indexed, ts, idx)
    return files.withColumn("digits", file_stem(F.col("file"))).join(rows, "digits")


# The reasons a file is left out.
NOT_IN_METADATA = "not in metadata"
NO_ROW = "no matching timestamp"
SHORT_HISTORY = "not enough history"


def file_status(
    files: DataFrame, metadata: DataFrame, indexed: DataFrame, seq_length: int, ts: str = "ts", idx: str = "idx"
) -> DataFrame:
    """Every file with the reason it is skipped, NULL if it is processed."""
    known = metadata.select("file").distinct().withColumn("_known", F.lit(True))
    rows = first_rows(indexed, ts, idx).withColumnRenamed("idx", "_row")
    return (
        files.select("file", file_stem(F.col("file")).alias("digits"))
        .join(known, "file", "left")
        .join(rows, "digits", "left")
        .select(
            "file",
            F.when(F.col("_known").isNull(), NOT_IN_METADATA)
            .when(F.col("_row").isNull(), NO_ROW)
            .when(F.col("_row") < seq_length - 1, SHORT_HISTORY)
            .alias("reason"),
        )
    )


def skipped_files(status: DataFrame) -> DataFrame:
    return status.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))
