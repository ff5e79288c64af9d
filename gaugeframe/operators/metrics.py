"""Regression metrics and losses, one aggregation pass for each set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import log_cosh, r2_score, squared_error
from gaugeframe.operators.scaling import inverse_scale
from gaugeframe.plans.quantiles import exact_quantiles

TRUTH = "ground_truth"
PREDICTION = "prediction"
METRIC_NAMES = ("mse", "rmse", "mae", "medae", "r2", "explained_variance", "mean_error", "max_error", "min_error")


def prediction_errors(df: DataFrame, truth: str = TRUTH, prediction: str = PREDICTION) -> DataFrame:
    """Add error = prediction - truth."""
    return df.withColumn("error", F.col(prediction) - F.col(truth))


def _sums(truth: Column, prediction: Column) -> list[Column]:
    error = prediction - truth
    truth = F.when(error.isNotNull(), truth)
    return [
        F.count(error).cast("double").alias("_n"),
        F.sum(squared_error(truth, prediction)).alias("_sse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("mean_error"),
        F.max(F.abs(error)).alias("max_error"),
        F.min(F.abs(error)).alias("min_error"),
        F.var_pop(truth).alias("_var_y"),
        F.min(truth).alias("_min_y"),
        F.max(truth).alias("_max_y"),
        F.var_pop(error).alias("_var_e"),
        F.min(error).alias("_min_e"),
        F.max(error).alias("_max_e"),
    ]


def _derived() -> dict[str, Column]:
    n, sse = F.col("_n"), F.col("_sse")
    constant = F.col("_min_y") == F.col("_max_y")
    level = F.col("_min_e") == F.col("_max_e")
    return {
        "mse": sse / n,
        "rmse": F.sqrt(sse / n),
        "r2": r2_score(n, sse, F.col("_var_y"), F.col("_min_y"), F.col("_max_y")),
        "explained_variance": F.when(constant, F.when(level, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
            1.0 - F.col("_var_e") / F.col("_var_y")
        ),
    }


def regression_metrics(
    predictions: DataFrame,
    groups: Sequence[str] = ("model",),
    truth: str = TRUTH,
    prediction: str = PREDICTION,
    approximate_median: bool = False,
    median: bool = True,
) -> DataFrame:
    """mse, rmse, mae, medae, r2, explained_variance, mean/max/min error per group.

    Everything but the median combines before the shuffle. The exact median goes through
    ``plans.quantiles``; ``approximate_median`` uses a sketch in the same pass instead.
    Without ``median`` there is no medae column and one pass is all.
    """
    groups = list(groups)
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    if median and not approximate_median:
        size = predictions.withColumn("_abs_error", F.abs(p - y))
        table = exact_quantiles(size, "_abs_error", {"medae": 0.5}, groups, extra=_sums(y, p))
        return table.withColumns(_derived()).select(*groups, *METRIC_NAMES)
    extra = [F.percentile_approx(F.abs(p - y), 0.5).alias("medae")] if median else []
    table = predictions.groupBy(*groups).agg(*_sums(y, p), *extra).withColumns(_derived())
    if not median:
        return table.select(*groups, *[name for name in METRIC_NAMES if name != "medae"])
    return table.select(*groups, *METRIC_NAMES)


def eval_metrics_scaled(scored: DataFrame, truth: str = "y", prediction: str = PREDICTION) -> DataFrame:
    """mse, mae, r2 in the scaled space."""
    table = scored.agg(*_sums(F.col(truth), F.col(prediction))).withColumns(_derived())
    return table.select("mse", "mae", "r2")


def eval_losses(scored: DataFrame, truth: str = "y", prediction: str = PREDICTION) -> DataFrame:
    """Both losses with the scaled metrics."""
    y, p = F.col(truth), F.col(prediction)
    table = scored.agg(*_sums(y, p), loss_mse(y, p).alias("loss_mse"), loss_log_cosh(y, p).alias("loss_log_cosh"))
    return table.withColumns(_derived()).select("loss_mse", "loss_log_cosh", "mse", "mae", "r2")


def eval_metrics_original(
    scored: DataFrame, scaler: DataFrame, target: str, truth: str = "y", prediction: str = PREDICTION
) -> DataFrame:
    """mse, mae and the range of the target after undoing the scaling."""
    original = inverse_scale(scored.select(truth, prediction), scaler, [truth, prediction], target)
    table = original.agg(*_sums(F.col(truth), F.col(prediction))).withColumns(_derived())
    return table.select("mse", "mae", F.col("_min_y").alias("target_min"), F.col("_max_y").alias("target_max"))


def eval_metrics(scored: DataFrame, scaler: DataFrame, target: str, truth: str = "y", prediction: str = PREDICTION) -> DataFrame:
    """The metrics of both spaces in one pass over the scored rows."""
    original = inverse_scale(
        scored.select(truth, prediction, F.col(truth).alias("_y"), F.col(prediction).alias("_p")), scaler, ["_y", "_p"], target
    )
    error = F.col("_p") - F.col("_y")
    table = original.agg(
        *_sums(F.col(truth), F.col(prediction)),
        F.avg(error * error).alias("mse_original"),
        F.avg(F.abs(error)).alias("mae_original"),
        F.min("_y").alias("target_min"),
        F.max("_y").alias("target_max"),
    ).withColumns(_derived())
    return table.select("mse", "mae", "r2", "mse_original", "mae_original", "target_min", "target_max")


def file_validation_metrics(predictions: DataFrame, truth: str = TRUTH, prediction: str = PREDICTION) -> DataFrame:
    """mse, rmse, mae, r2 and bias over all validated files."""
    table = predictions.agg(*_sums(F.col(truth), F.col(prediction))).withColumns(_derived())
    return table.select("mse", "rmse", "mae", "r2", F.col("mean_error").alias("bias"))


def loss_mse(truth: Column, prediction: Column) -> Column:
    return F.avg(squared_error(truth, prediction))


def loss_log_cosh(truth: Column, prediction: Column) -> Column:
    return F.avg(log_cosh(prediction - truth))


def error_extent(
    predictions: DataFrame, groups: Sequence[str] = ("model",), truth: str = TRUTH, prediction: str = PREDICTION
) -> DataFrame:
    """Range of truth and prediction together, for the identity line."""
    return predictions.groupBy(*groups).agg(
        F.least(F.min(truth), F.min(prediction)).alias("low"),
        F.greatest(F.max(truth), F.max(prediction)).alias("high"),
    )
