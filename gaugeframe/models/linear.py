"""Linear regression on the flattened sequence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.models.frames import fit_rows
from gaugeframe.models.moments import Moments, moments, solve
from gaugeframe.operators.sequences import feature_step_names

MODEL_SCHEMA = "position INT, weight DOUBLE, bias DOUBLE"


@dataclass(frozen=True)
class LinearModel:
    """Weights by flattened position and an intercept; scored by column functions."""

    weights: tuple[float, ...]
    intercept: float
    prediction_col: str = "prediction"

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights)

    @property
    def numFeatures(self) -> int:  # noqa: N802, as of the other models
        return len(self.weights)

    def getPredictionCol(self) -> str:  # noqa: N802
        return self.prediction_col

    def setPredictionCol(self, name: str) -> LinearModel:  # noqa: N802
        return replace(self, prediction_col=name)

    def prediction(self, values: Column) -> Column:
        """The prediction from an array of inputs, NULL if it has fewer than the model.

        ``values`` is named once: written out term by term, the array would be made again for every input,
        in code too long to be compiled.
        """
        if not self.weights:
            return F.lit(self.intercept)
        own = F.slice(values, 1, len(self.weights))
        terms = F.zip_with(own, F.array(*map(F.lit, self.weights)), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + F.lit(self.intercept)

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn(self.prediction_col, self.prediction(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), self.intercept) for i, w in enumerate(self.weights)] or [(None, None, self.intercept)]
        spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        rows = spark.read.schema(MODEL_SCHEMA).parquet(path).orderBy("position").collect()
        return cls(tuple(r["weight"] for r in rows if r["position"] is not None), rows[0]["bias"])


def fitted(found: Moments, l1: float = 0.0, l2: float = 0.0) -> LinearModel:
    """The model of one setting from sums that serve every setting."""
    weights, intercept = solve(found, l1, l2)
    return LinearModel(tuple(map(float, weights)), intercept)


def fit_linear(
    frame: DataFrame, n_features: int, l1: float = 0.0, l2: float = 0.0, max_iter: int = 100, solver: str = "normal"
) -> LinearModel | LinearRegressionModel:
    """Minimise mean(e^2) + l1*sum|w| + l2*sum(w^2) over the complete rows of ``frame``.

    ``solver="normal"`` solves from the sums of one pass over the rows (``models.moments``) and
    takes at most 4096 features. ``"l-bfgs"`` takes any number and fails if it has not
    converged after ``max_iter`` steps; Spark divides its quadratic penalty by the sample
    deviation of the target, which is undone here.
    """
    if solver == "normal":
        return fitted(moments(frame, n_features).get("all", Moments(0, 0, np.zeros(n_features + 1), np.zeros((0, 0)))), l1, l2)
    reg = l1 / 2.0
    frame = fit_rows(frame)
    if l2:
        spread = frame.agg(F.stddev_samp("y")).first()[0]
        reg += l2 * float(spread or 0.0)
    model = LinearRegression(
        featuresCol="features",
        labelCol="y",
        standardization=False,
        solver=solver,
        regParam=reg,
        elasticNetParam=(l1 / 2.0) / reg if reg else 0.0,
        maxIter=max_iter,
        tol=1e-9,
    ).fit(frame)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"not converged after {max_iter} iterations; raise max_iter")
    return model


def linear_importance(
    spark: SparkSession, model: LinearModel | LinearRegressionModel, features: Sequence[str], seq_length: int
) -> DataFrame:
    """(feature, weight, bias) of a fitted model, one row per coefficient."""
    names = feature_step_names(features, seq_length)
    rows = [(n, float(w), float(model.intercept)) for n, w in zip(names, model.coefficients.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature STRING, weight DOUBLE, bias DOUBLE")
