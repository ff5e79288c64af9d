"""Dataset profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import coefficient_of_variation
from gaugeframe.plans.quantiles import exact_quantiles
from gaugeframe.schemas import METRICS, TARGET

# The spacing of windows the size estimate assumes, in seconds.
WINDOW_STEP_SECONDS = 10


def profile_values(samples: DataFrame, windows: DataFrame | None = None, metrics: Sequence[str] = METRICS["new"]) -> DataFrame:
    """(metric, value) of all sub-samples, and of the window targets."""
    tall = samples.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
    if windows is not None:
        tall = tall.unionByName(windows.select(F.lit(TARGET).alias("metric"), F.col(TARGET).alias("value")))
    return tall.where(F.col("value").isNotNull())


def dataset_profile(values: DataFrame, approximate: bool = False) -> DataFrame:
    """min, max, mean, median, std, quartiles and coefficient of variation per metric.

    Few metrics hold all the rows, so the exact quantiles never gather a metric in one task.
    """
    quartiles = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    sums = [F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")]
    if approximate:
        table = values.groupBy("metric").agg(*sums, *[F.percentile_approx("value", p).alias(n) for n, p in quartiles.items()])
    else:
        table = exact_quantiles(values, "value", quartiles, ["metric"], extra=sums)
    return table.select(
        "metric", "min", "max", "mean", "median", "std", "p25", "p75",
        coefficient_of_variation(F.col("std"), F.col("mean")).alias("cv"),
    )


def dataset_span(windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Files, first and last time, span in seconds and the duration estimated from the count."""
    span = windows.agg(F.count(F.lit(1)).alias("n_files"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    return span.withColumn(
        "span_seconds", F.unix_seconds(F.col("end_ts").cast("timestamp")) - F.unix_seconds(F.col("start_ts").cast("timestamp"))
    ).withColumn("estimated_hours", (F.col("n_files") - 1) * F.lit(float(WINDOW_STEP_SECONDS)) / 3600.0)
