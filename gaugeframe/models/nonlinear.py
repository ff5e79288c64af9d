"""A non-linear regressor on the flattened sequence."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.models.frames import fit_rows


def fit_nonlinear(
    frame: DataFrame,
    max_depth: int = 3,
    max_iter: int = 20,
    step: float = 0.1,
    validation: str | None = None,
    tolerance: float = 0.01,
    seed: int = 0,
    max_bins: int = 32,
) -> GBTRegressionModel:
    """Boosted trees; inputs of at most ``max_bins`` values are split at any of them. ``validation`` names a boolean column: rows that decide when to stop early."""
    settings = {"featuresCol": "features", "labelCol": "y", "maxDepth": max_depth, "maxIter": max_iter, "stepSize": step, "seed": seed, "maxBins": max_bins}
    if validation:
        settings |= {"validationIndicatorCol": validation, "validationTol": tolerance}
        frame = frame.withColumn(validation, F.coalesce(validation, F.lit(False)))
    return GBTRegressor(**settings).fit(fit_rows(frame))
