"""Readers for validation metadata, result tables, importance files and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import try_double
from gaugeframe.schemas import EXPERIMENT_SCHEMA, IMPORTANCE_SCHEMA, RESULTS_SCHEMA

METADATA_SCHEMA = (
    "creation_timestamp STRING, format STRING, sample_ratio DOUBLE, random_seed LONG, "
    "files MAP<STRING, STRUCT<ground_truth_qoe: DOUBLE>>"
)


def metadata_from_text(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per (file, ground_truth_qoe) of the metadata documents."""
    parsed = df.select(F.from_json(value, METADATA_SCHEMA).alias("m"))
    return parsed.select(F.explode("m.files").alias("file", "info"), F.col("m.format").alias("format")).select(
        "file", F.col("info.ground_truth_qoe").alias("ground_truth_qoe"), "format"
    )


def scan_validation_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_from_text(spark.read.text(path, wholetext=True))


def scan_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results; the literal ``null`` becomes NULL."""
    raw = spark.read.schema(RESULTS_SCHEMA).option("header", True).option("nullValue", "null").csv(path)
    return type_results(raw)


def type_results(df: DataFrame) -> DataFrame:
    number = lambda name: try_double(F.col(name))
    return df.select(
        F.col("Model").alias("model"),
        F.col("Model Type").alias("model_type"),
        number("MSE").alias("mse"),
        number("MAE").alias("mae"),
        number("R2").alias("r2"),
        number("Inference Latency (ms)").alias("latency_ms"),
    )


def scan_experiments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Experiment runs; a loss that is not a number becomes NULL."""
    raw = (
        spark.read.schema(EXPERIMENT_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return raw.withColumn("test_loss", try_double(F.col("test_loss")))


def importance_from_text(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per weight of the importance documents; documents that do not parse give none."""
    parsed = df.select(F.from_json(value, IMPORTANCE_SCHEMA).alias("d"))
    return parsed.select(
        F.col("d.model_name").alias("model_name"),
        F.col("d.bias").alias("bias"),
        F.posexplode("d.feature_importance").alias("position", "w"),
    ).select("model_name", "bias", "position", F.col("w.feature").alias("feature"), F.col("w.weight").alias("weight"))


def scan_importance(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("wholetext", True).option("pathGlobFilter", "*.importance.json").text(path)
    return importance_from_text(docs)


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines) of captured outputs, one row per log."""
    whole = spark.read.format("text").option("wholetext", True).load(path)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))


def scan_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of captured outputs; a log is split where it was read, not gathered."""
    return scan_logs(spark, path).select("file", F.posexplode("lines").alias("line_no", "line"))


def _word(line: Column, n: int) -> Column:
    return F.nullif(F.get(F.split(F.trim(line), r"\s+"), F.lit(n - 1)), F.lit(""))


# The marks of the log format and the word that holds the number.
TYPE_MARK = "Detected model type:"
MARKS = {
    "mse": ("Mean Squared Error (MSE):", 5),
    "mae": ("Mean Absolute Error (MAE):", 5),
    "r2": ("R^2 Score:", 3),
    "latency_ms": ("Average Inference Latency on Current System:", 7),
}
FAILURES = ("Error:", "Traceback")
LOSS_MARK = "Test Loss:"


def _kind(line: Column) -> Column:
    return F.replace(F.split_part(line, F.lit(":"), F.lit(2)), F.lit(" "), F.lit(""))


def _failure(line: Column) -> Column:
    bad = F.lit(False)
    for mark in FAILURES:
        bad = bad | F.contains(line, F.lit(mark))
    return bad


def _log_row(found: DataFrame) -> DataFrame:
    """The metric row from ``_type``, ``_error`` and the text of each metric."""
    complete = F.lit(True)
    for name in MARKS:
        complete = complete & F.col(f"_{name}").isNotNull()
    failed = F.col("_error").isNotNull()
    return found.select(
        F.col("file").alias("model"),
        F.when(failed, F.lit("ERROR")).otherwise(F.col("_type")).alias("model_type"),
        *[F.when(~failed & complete, try_double(F.col(f"_{name}"))).alias(name) for name in MARKS],
        F.when(failed, F.lit("FAILED")).when(~complete, F.lit("INCOMPLETE METRICS")).otherwise(F.lit("OK")).alias("status"),
        F.col("_error").alias("error"),
    )


def log_metrics(logs: DataFrame, lines: str = "lines") -> DataFrame:
    """One metric row per log (file, lines): the first value of each metric, FAILED and INCOMPLETE marked, the error kept.

    Everything happens inside the row, without a shuffle. ``error`` holds the lines that tell of a
    failure. For logs too long for a row see :func:`extract_log_metrics`.
    """
    listed = F.col(lines)

    def first(mark: str) -> Column:
        return F.get(F.filter(listed, lambda line: F.contains(line, F.lit(mark))), F.lit(0))

    error = F.nullif(F.array_join(F.filter(listed, _failure), "\n"), F.lit(""))
    found = {"_type": F.nullif(_kind(first(TYPE_MARK)), F.lit(""))} | {f"_{name}": _word(first(mark), n) for name, (mark, n) in MARKS.items()}
    return _log_row(logs.select("file", error.alias("_error"), *[value.alias(name) for name, value in found.items()]))


def log_test_loss(logs: DataFrame, lines: str = "lines") -> DataFrame:
    """The loss on the last ``Test Loss:`` line of each log (file, lines); NULL if absent or not a number."""
    hits = F.filter(lines, lambda line: F.startswith(line, F.lit(LOSS_MARK)))
    text = F.trim(F.split_part(F.get(hits, F.size(hits) - 1), F.lit(":"), F.lit(2)))
    return logs.select("file", try_double(text).alias("test_loss"))


def extract_log_metrics(lines: DataFrame) -> DataFrame:
    """One metric row per log of (file, line_no, line): as :func:`log_metrics`, for logs of any length.

    Lines shrink to the few words wanted before they are grouped, and conditional
    aggregates combine them where they lie, so a long log is never gathered; of the error only the first line is kept.
    """
    line = F.col("line")

    def on(mark: str, value: Column) -> Column:
        """``value`` on the lines with the mark; blank if such a line has none."""
        return F.when(F.contains(line, F.lit(mark)), F.coalesce(value, F.lit("")))

    words = {"_type": on(TYPE_MARK, _kind(line)), "_error": F.when(_failure(line), F.trim(line))}
    words |= {f"_{name}": on(mark, _word(line, n)) for name, (mark, n) in MARKS.items()}
    short = lines.select("file", "line_no", *[value.alias(name) for name, value in words.items()])
    first = {name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("line_no"))) for name in words}
    found = short.groupBy("file").agg(*[(value if name == "_error" else F.nullif(value, F.lit(""))).alias(name) for name, value in first.items()])
    return _log_row(found)


def extract_test_loss(lines: DataFrame) -> DataFrame:
    """The loss on the last ``Test Loss:`` line of each output; NULL if absent or not a number."""
    hit = F.startswith(F.col("line"), F.lit(LOSS_MARK))
    text = F.trim(F.split_part(F.col("line"), F.lit(":"), F.lit(2)))
    value = F.struct(try_double(text).alias("v"))
    return lines.groupBy("file").agg(
        F.max_by(F.when(hit, value), F.when(hit, F.col("line_no")))["v"].alias("test_loss")
    )
