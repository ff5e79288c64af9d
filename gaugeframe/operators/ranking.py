"""Top-k, rankings and summaries of model tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.text import short_label

# The ranked metrics of an evaluation table and whether higher is better.
EVALUATION_METRICS = {"mse": False, "mae": False, "r2": True, "latency_ms": False}


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark cuts each partition to ``k`` rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def top_errors(predictions: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest absolute errors of each model, with a short label per file."""
    sized = predictions.withColumn("abs_error", F.abs("error"))
    order = [F.col("abs_error").desc(), F.col("file"), F.col("prediction")]
    return top_per_group(sized, ["model"], order, k).withColumn("label", short_label(F.col("file")))


def melt_metrics(table: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics to (ids, metric, value)."""
    return table.unpivot(list(ids), list(metrics), "metric", "value")


def combine_models(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack per-model tables by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def _directed(metric: Column, value: Column, higher_is_better: dict[str, bool]) -> Column:
    best_high = [m for m, high in higher_is_better.items() if high]
    return F.when(metric.isin(*best_high), -value).otherwise(value) if best_high else value


def rank_models(metrics: DataFrame) -> DataFrame:
    """Rank models by r2 (high), rmse, mae and absolute bias (low).

    Runs on the aggregated table, one row per model.
    """
    table = metrics.select("model", "r2", "rmse", "mae", F.abs("mean_error").alias("bias"))
    tall = melt_metrics(table, ["model"], ["r2", "rmse", "mae", "bias"])
    key = _directed(F.col("metric"), F.col("value"), {"r2": True, "rmse": False, "mae": False, "bias": False})
    place = F.row_number().over(Window.partitionBy("metric").orderBy(key.asc_nulls_last(), "model"))
    return tall.withColumn("rank", place)


def top5_by_metric(results: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` rows by each metric, over rows without missing values."""
    tall = melt_metrics(results.na.drop(), ["model", "model_type"], list(EVALUATION_METRICS))
    key = _directed(F.col("metric"), F.col("value"), EVALUATION_METRICS)
    return top_per_group(tall, ["metric"], [key, F.col("model")], k)


def composite_scores(results: DataFrame) -> DataFrame:
    """Each metric to 0..1 (1 is best; 1 if all are equal) and the mean of the four."""
    valid = results.na.drop()
    ends = valid.agg(
        F.struct(*[f(m).alias(f"{k}_{m}") for m in EVALUATION_METRICS for k, f in (("lo", F.min), ("hi", F.max))]).alias("e")
    ).scalar()
    scored = valid.withColumn("_e", ends)
    scores = {}
    for m, high_is_best in EVALUATION_METRICS.items():
        low, high = F.col("_e")[f"lo_{m}"], F.col("_e")[f"hi_{m}"]
        share = (F.col(m) - low) / (high - low)
        scores[f"{m}_score"] = F.when(low == high, F.lit(1.0)).otherwise(share if high_is_best else 1.0 - share)
    mean = reduce(lambda a, b: a + b, [F.col(s) for s in scores]) / float(len(scores))
    return scored.withColumns(scores).withColumn("composite_score", mean).drop("_e")


def composite_ranking(results: DataFrame, k: int = 5) -> DataFrame:
    return composite_scores(results).orderBy(F.col("composite_score").desc(), "model").limit(k)


def count_by_type(results: DataFrame) -> DataFrame:
    """Rows per model type, failed ones included."""
    return results.groupBy("model_type").agg(F.count(F.lit(1)).alias("n_models"))


def mean_by_type(results: DataFrame) -> DataFrame:
    """Mean of every metric per type, over rows without missing values."""
    return results.na.drop().groupBy("model_type").agg(*[F.avg(m).alias(f"avg_{m}") for m in EVALUATION_METRICS])


def best_config(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The run with the lowest test loss of each model type; the first one on ties."""
    known = runs.where(F.col("test_loss").isNotNull())
    return top_per_group(known, ["model_type"], [F.col("test_loss"), F.col(order)], 1).drop("rank")


def best_by_validation_r2(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("r2").desc_nulls_last(), "model").limit(1)
