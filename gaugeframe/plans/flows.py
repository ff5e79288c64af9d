"""End-to-end flows over windows: train, evaluate, validate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.wrapper import JavaModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.models.frames import to_frame
from gaugeframe.models.linear import LinearModel
from gaugeframe.models.score import guard_width, score_sequences
from gaugeframe.operators.clean import is_valid_window, mask_target
from gaugeframe.operators.features import flatten_samples, widest_window, window_stats
from gaugeframe.operators.lookups import NOT_IN_METADATA, SHORT_HISTORY, file_status, join_file_to_row, skipped_files
from gaugeframe.operators.metrics import eval_metrics, regression_metrics
from gaugeframe.operators.scaling import fit_scaler, inverse_scale, scale
from gaugeframe.operators.sequences import asof_history, fallback_sequences, make_sequences, make_trailing_sequences, mean_pool
from gaugeframe.operators.splits import sample_exact, split_point, tail_test
from gaugeframe.plans.ordered import dense_index, row_total
from gaugeframe.schemas import SAMPLES_PER_WINDOW, TARGET, feature_names
from gaugeframe.session import materialize
from gaugeframe.sources.sinks import sink_validation_pair
from gaugeframe.sources.windows import to_windows, with_document


def feature_frame(
    windows: DataFrame, stats: bool = True, layout: str = "new", keep: Sequence[str] = ("file", "ts"), n_samples: int | None = SAMPLES_PER_WINDOW
) -> DataFrame:
    """Windows to flat features, optional statistics and the target.

    ``n_samples`` sub-samples make the features; None takes the longest window of the data.
    """
    if n_samples is None:
        n_samples = widest_window(windows)
    frame = flatten_samples(windows, layout, n_samples)
    if stats:
        frame = window_stats(frame, layout)
    return frame.select(*keep, *feature_names(layout, n_samples, stats), TARGET)


def scaled_order(
    frame: DataFrame,
    features: Sequence[str],
    order_by: Sequence[str],
    scaler: DataFrame | None = None,
    fit_on: str = "all",
    seq_length: int = 5,
    train_ratio: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """(indexed and scaled rows, scaler).

    The rows are ordered first, so the bounds and the sequences read the stored table
    instead of building the features twice. ``fit_on="train"`` takes the bounds only from
    rows that training sequences of ``seq_length`` use or predict.
    """
    indexed = dense_index(frame, order_by)
    if scaler is None:
        seen = indexed
        if fit_on == "train":
            sequences = F.greatest(row_total(indexed.select("idx")) - seq_length, F.lit(0))
            seen = indexed.where(F.col("idx") < split_point(sequences, train_ratio) + seq_length)
        scaler = fit_scaler(seen, features)
    return scale(indexed, scaler, [*features, TARGET]), scaler


def evaluate_baseline(windows: DataFrame, order_by: Sequence[str], seq_length: int = 5, test_ratio: float = 0.2) -> DataFrame:
    """Forecast the next target by the mean of the last ones and report metrics on the tail."""
    indexed, scaler = scaled_order(windows.select(*order_by, TARGET), [], order_by)
    made = make_sequences(indexed, seq_length, [TARGET])
    total = F.greatest(row_total(indexed.select("idx")) - seq_length, F.lit(0))
    tail = tail_test(made, test_ratio, total=total)
    scored = mean_pool(tail, 1).select("y", F.get("pooled", F.lit(0)).alias("prediction"))
    return eval_metrics(scored, scaler, TARGET)


NO_TRUTH = "no ground truth"


def validate_models(
    windows: DataFrame,
    models: dict[str, JavaModel | LinearModel],
    scaler: DataFrame,
    features: Sequence[str],
    order_by: Sequence[str],
    seq_length: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(predictions with truth, metrics per model) on windows whose target is hidden while scoring.

    ``windows`` has ``file``, the features and the target. A file is scored on the sequence
    that ends with its own row. Every file has a row for every model; where a prediction or the
    truth is NULL, ``reason`` says why: a missing feature, not enough history, no ground truth.
    """
    indexed, _ = scaled_order(mask_target(windows), features, order_by, scaler)
    made = make_trailing_sequences(indexed, seq_length, features, ["file"]).select("file", "X", F.lit(None).cast("string").alias("reason"))
    short = indexed.where(F.col("idx") < seq_length - 1)
    made = made.unionByName(short.select("file", F.lit(None).cast(made.schema["X"].dataType).alias("X"), F.lit(SHORT_HISTORY).alias("reason")))
    return _validated(made, windows, models, scaler, features)


def _validated(
    made: DataFrame, windows: DataFrame, models: dict[str, JavaModel | LinearModel], scaler: DataFrame, features: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Scores of the sequences of files, with the truth; (file, X, reason) in."""
    frame = to_frame(guard_width(made, len(features)))
    scored = score_sequences(models, frame).select("file", "model", "prediction", "reason")
    restored = inverse_scale(scored, scaler, ["prediction"])
    truth = windows.where(F.col(TARGET).isNotNull()).select("file", F.col(TARGET).alias("ground_truth"))
    joined = restored.join(truth, "file", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("ground_truth").isNull(), NO_TRUTH)))
    # Stored: the predictions are a result of their own, and the metrics read them more than once.
    predictions = materialize(joined, "predictions")
    return predictions, regression_metrics(predictions)


def validate_files(
    files: DataFrame,
    metadata: DataFrame,
    windows: DataFrame,
    models: dict[str, JavaModel | LinearModel],
    scaler: DataFrame,
    features: Sequence[str],
    order_by: Sequence[str],
    seq_length: int = 5,
    ts: str = "ts",
    fallback: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics per model, files left out by reason) for a folder of validation files.

    A file is in scope if ``metadata`` knows it, and is scored on the sequence that ends with the row whose
    time its name gives. Files without one have a row per model with the reason. With ``fallback``, and
    only if no file in scope matches a row, every file in scope is scored on the last rows. ``windows``
    bears the truth by ``file``.
    """
    indexed, _ = scaled_order(mask_target(windows), features, order_by, scaler)
    status = materialize(file_status(files, metadata, indexed, seq_length, ts), "status")
    matched = status.where(F.col("reason").isNull() | (F.col("reason") == SHORT_HISTORY))
    if fallback and matched.isEmpty():
        scope = status.where(F.col("reason") != NOT_IN_METADATA)
        found = fallback_sequences(scope.select("file"), indexed, seq_length, features, order_by)
        status = status.join(found.select("file", F.lit(True).alias("_found")).distinct(), "file", "left")
        status = status.withColumn("reason", F.when(F.col("_found").isNull(), F.col("reason"))).drop("_found")
    else:
        ending = make_trailing_sequences(indexed, seq_length, features)
        rows = join_file_to_row(status.where("reason is null").select("file"), indexed, ts)
        found = rows.select("file", "idx").join(ending, "idx")
    made = status.join(found.select("file", "X"), "file", "left").select("file", "X", "reason")
    predictions, metrics = _validated(made, windows, models, scaler, features)
    return predictions, metrics, skipped_files(status)


def prepare_validation(docs: DataFrame, path: str, ratio: float = 1.0, seed: int = 0, layout: str = "new") -> DataFrame:
    """Sample window documents, keep the valid ones and write the validation pair below ``path``.

    Returns one row with the numbers of valid and invalid documents.
    """
    chosen = with_document(sample_exact(docs, "file", ratio, seed)).withColumn("valid", is_valid_window(F.col("doc"), layout))
    checked = materialize(chosen.drop("doc"), "chosen")
    sink_validation_pair(to_windows(checked.where("valid").drop("valid"), layout), path, layout=layout, ratio=ratio, seed=seed)
    return checked.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def predict_records(
    new: DataFrame,
    history: DataFrame,
    models: dict[str, JavaModel | LinearModel],
    scaler: DataFrame,
    features: Sequence[str],
    seq_length: int,
    key: str,
    ts: str = "ts",
) -> DataFrame:
    """Predicted target of new records, each scored with the history before it; both are scaled alike.

    Every record has a row for every model. ``reason`` says why a prediction is NULL: a missing
    feature, or not enough history.
    """
    scaled_new = scale(new.select(key, ts, *features), scaler, features)
    scaled_history = scale(history.select(key, ts, *features), scaler, features)
    made = asof_history(scaled_new, scaled_history, seq_length, features, key, ts, keep_short=True)
    made = made.withColumn("reason", F.when(F.col("X").isNull(), SHORT_HISTORY))
    frame = to_frame(guard_width(made, len(features))).drop(*features)
    return inverse_scale(score_sequences(models, frame).select(key, "model", "prediction", "reason"), scaler, ["prediction"])
