"""Batch scoring, evaluation and the model registry."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.util import DefaultParamsReader, JavaMLWritable
from pyspark.ml.wrapper import JavaModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.text import classify_model
from gaugeframe.models.frames import MISSING_VALUE, complete, predict
from gaugeframe.models.linear import LinearModel
from gaugeframe.operators.metrics import eval_losses

LINEAR_TABLE = "linear table"


def guard_width(sequences: DataFrame, n_features: int, x: str = "X") -> DataFrame:
    """Fail on a sequence whose rows do not have the features the model was fitted on; a NULL one stays."""
    fits = F.col(x).isNull() | F.forall(x, lambda row: F.size(row) == n_features)
    message = F.lit(f"the model expects {n_features} features per step; check the statistics setting")
    return sequences.withColumn(x, F.when(fits, F.col(x)).otherwise(F.raise_error(message)))


def score_sequences(models: dict[str, JavaModel | LinearModel], frame: DataFrame) -> DataFrame:
    """Predictions of every model for every sequence: one narrow pass, all models side by side.

    ``reason`` says why a prediction is NULL. A row that brings a reason keeps it.
    """
    scored = frame
    for i, model in enumerate(models.values()):
        scored = predict(model, scored, f"_p{i}")
    known = F.col("reason") if "reason" in frame.columns else F.lit(None).cast("string")
    scored = scored.withColumn("reason", F.coalesce(known, F.when(~complete(), MISSING_VALUE)))
    pairs = F.array(
        *[F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, name in enumerate(models)]
    )
    keep = [c for c in frame.columns if c not in ("features", "X", "complete", "reason")]
    return scored.select(*keep, "reason", F.inline(pairs))


def score_external(
    sequences: DataFrame, predict: Callable[[np.ndarray], np.ndarray], seq_length: int, n_features: int, x: str = "X"
) -> DataFrame:
    """Predictions of a model trained elsewhere.

    ``predict`` gets a float array (rows, seq_length, n_features) per Arrow batch, a view of the
    batch itself, and returns one value per row. A missing value makes the prediction NULL; a
    sequence of another shape is an error.
    """

    @F.arrow_udf("double")
    def run(flat: pa.Array) -> pa.Array:
        known = pc.is_valid(flat)
        rows = flat.filter(known)
        if not len(rows):
            return pa.nulls(len(flat), pa.float64())
        if pc.min_max(pc.list_value_length(rows)).as_py() != {"min": seq_length * n_features, "max": seq_length * n_features}:
            raise ValueError(f"a sequence does not have {seq_length} steps of {n_features} features")
        batch = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, seq_length, n_features)
        out = np.full(len(flat), np.nan)
        out[known.to_numpy(zero_copy_only=False)] = np.asarray(predict(batch), dtype="float64").reshape(-1)
        return pa.array(out, mask=~known.to_numpy(zero_copy_only=False))

    flat = F.transform(F.flatten(x), lambda v: v.cast("double"))
    return sequences.withColumn("prediction", run(F.when(F.forall(flat, lambda v: v.isNotNull()), flat)))


def attention_pool(
    sequences: DataFrame, weights: np.ndarray, bias: np.ndarray, context: np.ndarray, x: str = "X", out: str = "pooled"
) -> DataFrame:
    """Softmax over time of tanh(X W + b) u, then the weighted sum of the steps.

    Array functions only; the weights are model-sized literals. A missing value makes the
    result NULL.
    """

    def logit(row: Column) -> Column:
        total = F.lit(0.0)
        for j in range(weights.shape[1]):
            inner = F.lit(float(bias[j]))
            for i in range(weights.shape[0]):
                inner = inner + F.get(row, F.lit(i)) * float(weights[i, j])
            total = total + F.tanh(inner) * float(context[j])
        return total

    def weighted(steps: Column, shares: Column, i: int) -> Column:
        terms = F.zip_with(steps, shares, lambda row, share: F.get(row, F.lit(i)) * share)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    scored = sequences.withColumn("_logits", F.transform(x, logit))
    largest = F.array_max("_logits")
    scored = scored.withColumn("_powers", F.transform("_logits", lambda v: F.exp(v - largest)))
    total = F.aggregate("_powers", F.lit(0.0), lambda a, b: a + b)
    scored = scored.withColumn("_shares", F.transform("_powers", lambda v: v / total))
    pooled = F.array(*[weighted(F.col(x), F.col("_shares"), i) for i in range(weights.shape[0])])
    known = F.forall(x, lambda row: F.forall(row, lambda v: v.isNotNull()))
    return scored.withColumn(out, F.when(known, pooled)).drop("_logits", "_powers", "_shares")


def evaluate_model(model: JavaModel | LinearModel, frame: DataFrame) -> DataFrame:
    """Both losses, mse, mae and r2 of a model on held-out sequences."""
    return eval_losses(predict(model, frame).select("y", "prediction"))


def save_model(spark: SparkSession, name: str, model: JavaMLWritable | LinearModel, folder: str) -> None:
    """Write a model and add its line to the registry in the same folder."""
    path = f"{folder}/{name}"
    linear = isinstance(model, LinearModel)
    if linear:
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    line = spark.createDataFrame([(name, path, LINEAR_TABLE if linear else None)], "model STRING, path STRING, kind STRING")
    line.withColumn("model_type", classify_model(F.col("model"))).write.mode("append").parquet(f"{folder}/_registry")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """(model, path, model_type, kind), one row per saved model; no kind means a model in Spark's own format."""
    table = spark.read.schema("model STRING, path STRING, model_type STRING, kind STRING").parquet(f"{folder}/_registry")
    return table.dropDuplicates(["model"])


def load_registered(spark: SparkSession, folder: str, name: str | None = None) -> tuple[dict[str, JavaModel | LinearModel], dict[str, str]]:
    """One model or all of a folder, and the reason for each that cannot be read."""
    lines = registry(spark, folder)
    if name:
        lines = lines.where(F.col("model") == name)
    loaded, failed = {}, {}
    for line in lines.orderBy("model").collect():
        try:
            if line["kind"] == LINEAR_TABLE:
                loaded[line["model"]] = LinearModel.load(spark, line["path"])
            else:
                loaded[line["model"]] = DefaultParamsReader.loadParamsInstance(line["path"], spark.sparkContext)
        except Exception as error:  # noqa: BLE001
            failed[line["model"]] = str(error)
    return loaded, failed


def load_models(spark: SparkSession, folder: str, name: str | None = None) -> dict[str, JavaModel | LinearModel]:
    """One model or all of a folder; those that cannot be read are skipped (see :func:`load_registered`)."""
    return load_registered(spark, folder, name)[0]
