"""Feature-importance roll-ups over (feature, weight) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.text import base_feature, lag_step, stat_suffix
from gaugeframe.operators.ranking import top_per_group


def parse_feature_names(weights: DataFrame) -> DataFrame:
    name = F.col("feature")
    return weights.withColumns(
        {"base_feature": base_feature(name), "step": lag_step(name), "stat": stat_suffix(name)}
    )


def _roll_up(weights: DataFrame, key: Column, name: str) -> DataFrame:
    """Sum per feature name first, so names are taken apart once and not per weight."""
    named = weights.groupBy("feature").agg(F.sum(F.abs("weight")).alias("_sum"), F.count("weight").alias("_n"))
    return (
        named.select(key.alias(name), "_sum", "_n")
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.sum("_sum").alias("total_importance"), F.sum("_n").alias("n_features"))
        .withColumn("avg_importance", F.try_divide("total_importance", "n_features"))
    )


def importance_by_base(weights: DataFrame) -> DataFrame:
    return _roll_up(weights, base_feature(F.col("feature")), "base_feature")


def importance_by_step(weights: DataFrame) -> DataFrame:
    return _roll_up(weights, lag_step(F.col("feature")), "step")


def importance_by_stat(weights: DataFrame) -> DataFrame:
    return _roll_up(weights, stat_suffix(F.col("feature")), "stat")


def top_features(weights: DataFrame, k: int = 10, groups: Sequence[str] = ("model_name",)) -> DataFrame:
    """The ``k`` largest absolute weights of each model."""
    return top_per_group(weights, groups, [F.abs("weight").desc(), F.col("feature"), F.col("weight")], k)


def rank_base_features(rolled: DataFrame, name: str = "base_feature") -> DataFrame:
    """A roll-up with its rank by average importance, largest first; one row per feature name."""
    place = F.row_number().over(Window.orderBy(F.col("avg_importance").desc_nulls_last(), name))
    return rolled.withColumn("rank", place)


def rank_steps(rolled: DataFrame) -> DataFrame:
    """The roll-up by lag, oldest first."""
    return rolled.orderBy(F.col("step").desc())
