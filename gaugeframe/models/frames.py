"""Sequences as Spark ML frames."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.ml.functions import array_to_vector
from pyspark.ml.wrapper import JavaModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from gaugeframe.models.linear import LinearModel

MISSING_VALUE = "missing value"


def to_frame(sequences: DataFrame, x: str = "X") -> DataFrame:
    """Add ``features`` and ``complete``, which is false for a sequence with a missing value.

    No row is left out: such sequences stay (with zeros in place of what is missing), are not
    fitted on and get a NULL prediction.
    """
    flat = F.flatten(x)
    whole = F.coalesce(F.forall(flat, lambda v: v.isNotNull()), F.lit(False))
    filled = F.transform(flat, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    return sequences.withColumns({"complete": whole, "features": F.when(flat.isNotNull(), array_to_vector(filled))})


def complete() -> Column:
    return F.col("complete")


def fit_rows(frame: DataFrame) -> DataFrame:
    """The rows a model can be fitted on: all features and the target are known."""
    return frame.where(complete() & F.col("y").isNotNull())


def left_out(frame: DataFrame) -> DataFrame:
    """One row: how many sequences a fit uses (n_used) and leaves out (n_left_out)."""
    used = complete() & F.col("y").isNotNull()
    return frame.agg(F.count_if(used).alias("n_used"), F.count_if(~used).alias("n_left_out"))


def predict(model: JavaModel | LinearModel, frame: DataFrame, out: str = "prediction") -> DataFrame:
    """Add the prediction of every row, NULL for incomplete ones. The model itself is not changed."""
    if hasattr(model, "prediction"):
        return frame.withColumn(out, F.when(complete(), model.prediction(F.flatten("X"))))
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), model.numFeatures))
    ready = frame.withColumn("features", F.coalesce("features", zeros))
    scored = model.copy({model.predictionCol: out}).transform(ready)
    return scored.withColumn(out, F.when(complete(), F.col(out)))
