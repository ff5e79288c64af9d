"""End-to-end flows on small planted data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.models.frames import to_frame
from gaugeframe.models.linear import LinearModel, fit_linear
from gaugeframe.models.search import grid_search, variant_configs
from gaugeframe.operators import generate
from gaugeframe.operators.scaling import fit_scaler
from gaugeframe.operators.sequences import asof_history, make_sequences
from gaugeframe.plans import flows
from gaugeframe.schemas import TARGET, feature_names
from gaugeframe.sources import sinks


@pytest.fixture(scope="module")
def windows(spark):
    return generate.generate_windows(generate.window_starts(spark, "20250102090000", 329), seed=1)


def test_sizes_of_the_training_flow(spark, windows):
    features = feature_names(stats=True)
    assert len(features) == 45
    indexed, scaler = flows.scaled_order(flows.feature_frame(windows), features, ["ts", "file"])
    assert scaler.count() == 46 and scaler.orderBy("pos").collect()[-1]["col"] == TARGET
    made = make_sequences(indexed, 5, features)
    first = made.where("seq = 0").first()
    assert made.count() == 324 and np.array(first.X).shape == (5, 45)
    low, high = made.agg(F.min("y"), F.max("y")).first()
    assert 0 <= low < high <= 1


def test_baseline(spark, windows):
    row = flows.evaluate_baseline(windows, ["ts", "file"]).first()
    targets = [r.QoE for r in windows.orderBy("ts").collect()]
    y = np.array(targets[-64:])
    p = np.array([np.mean(targets[i - 5 : i]) for i in range(len(targets) - 64, len(targets))])
    assert row.mse_original == pytest.approx(((p - y) ** 2).mean())
    assert row.r2 == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert (row.target_min, row.target_max) == pytest.approx((y.min(), y.max()))


def test_scaler_fitted_on_training_rows(spark):
    rows = spark.createDataFrame([(i, float(i), float(i)) for i in range(25)], "t int, f0 double, QoE double")
    _, everything = flows.scaled_order(rows, ["f0"], ["t"])
    _, train = flows.scaled_order(rows, ["f0"], ["t"], fit_on="train", seq_length=5)
    top = lambda s: s.where("col = 'f0'").first()["max"]
    # 20 sequences, 16 of them for training: the last predicts row 20.
    assert (top(everything), top(train)) == (24.0, 20.0)


def test_validation_scores_the_row_a_sequence_ends_with(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 10, 60)
    rows = spark.createDataFrame(
        [(f"{i}.json", i, float(v), float(50 + 3 * v)) for i, v in enumerate(x)], "file string, t int, f0 double, QoE double"
    )
    indexed, scaler = flows.scaled_order(rows, ["f0"], ["t"])
    # A model that knows the target depends on the newest step only.
    paired = indexed.select(F.array(F.array(F.lit(0.5)), F.array("f0")).alias("X"), F.col(TARGET).alias("y"), "idx")
    frame = to_frame(paired.withColumn("X", F.transform("X", lambda s: F.transform(s, lambda v: v + F.col("idx") % 2 * 0.0))))
    model = fit_linear(frame, 2)
    predictions, metrics = flows.validate_models(rows, {"linear_last": model}, scaler, ["f0"], ["t"], 2)
    by_reason = {r.reason: r["count"] for r in predictions.groupBy("reason").count().collect()}
    assert by_reason == {None: 59, "not enough history": 1}
    assert metrics.first().max_error == pytest.approx(0.0, abs=1e-6)


def test_every_file_of_a_validation_has_a_row(spark):
    """Files outside the metadata, without a row, with too little history or without truth have a reason."""
    stamp = lambda i: f"202501300659{i:02d}.json"
    rows = [(stamp(i), i, float(i), None if i == 7 else 2.0 * i) for i in range(12)]
    windows = spark.createDataFrame(rows, "file string, n int, f0 double, QoE double")
    windows = windows.withColumn("ts", F.to_timestamp(F.substring("file", 1, 14), "yyyyMMddHHmmss"))
    scaler = fit_scaler(windows, ["f0"])
    # Scaled inputs and targets are the same: the newest step is the target.
    models = {"last": LinearModel((0.0, 0.0, 1.0), 0.0)}
    files = spark.createDataFrame([(stamp(i),) for i in (1, 4, 7, 11)] + [("20250130080000.json",), ("other.json",)], "file string")
    metadata = files.where("file <> 'other.json'")
    run = lambda f, m, **more: flows.validate_files(f, m, windows, models, scaler, ["f0"], ["ts"], 3, **more)
    predictions, metrics, skipped = run(files, metadata)
    got = {r.file: (r.reason, r.prediction) for r in predictions.collect()}
    assert got == {
        stamp(1): ("not enough history", None), stamp(4): (None, pytest.approx(8.0)), stamp(7): ("no ground truth", pytest.approx(14.0)),
        stamp(11): (None, pytest.approx(22.0)), "20250130080000.json": ("no matching timestamp", None), "other.json": ("not in metadata", None),
    }
    assert metrics.first().max_error == pytest.approx(0.0, abs=1e-9)
    assert {r.reason: r.n_files for r in skipped.collect()} == {"not enough history": 1, "no matching timestamp": 1, "not in metadata": 1}
    unmatched = files.where("file in ('20250130080000.json', 'other.json')")
    predictions, _, skipped = run(unmatched, metadata, fallback=True)
    assert {r.file: r.prediction for r in predictions.collect()} == {"20250130080000.json": pytest.approx(22.0), "other.json": None}
    assert {r.reason for r in skipped.collect()} == {"not in metadata"}


def test_records_with_too_little_history_have_a_reason(spark):
    history = spark.createDataFrame([(i, i, float(i), 2.0 * i) for i in range(5)], "id int, t int, f0 double, QoE double")
    new = spark.createDataFrame([(10, 1, 9.0), (11, 3, 2.0), (12, 99, None), (13, 99, 4.0)], "id int, t int, f0 double")
    models = {"last": LinearModel((0.0, 0.0, 1.0), 0.0)}
    scored = flows.predict_records(new, history, models, fit_scaler(history, ["f0"]), ["f0"], 3, "id", "t")
    got = {r.id: (r.prediction, r.reason) for r in scored.collect()}
    assert got == {10: (None, "not enough history"), 11: (pytest.approx(4.0), None), 12: (None, "missing value"), 13: (pytest.approx(8.0), None)}


def test_prepared_validation_set(spark, windows, tmp_path):
    docs = windows.select(
        "file", sinks.window_json(F.when(F.col("window_id") % 4 > 0, F.col(TARGET)), F.col("ts"), F.col("samples")).alias("value")
    )
    counts = flows.prepare_validation(docs, str(tmp_path / "v"), 0.5, seed=2).first()
    assert counts.n_valid + counts.n_invalid == 164 and counts.n_invalid > 0
    truth, masked, metadata = sinks.load_validation_pair(spark, str(tmp_path / "v"))
    assert truth.count() == masked.count() == metadata.count() == counts.n_valid
    assert masked.where("QoE IS NOT NULL").count() == 0


def test_sequence_of_one_needs_no_history(spark):
    new = spark.createDataFrame([(1, 5, 2.0)], "id int, t int, v double")
    made = asof_history(new, new.where("id < 0"), 1, ["v"], "id", "t").collect()
    assert [r.X for r in made] == [[[2.0]]]


def test_linear_variants(spark, windows):
    features = ["f0", "f3"]
    frame = flows.feature_frame(windows, stats=False)
    indexed, _ = flows.scaled_order(frame, features, ["ts", "file"])
    ready = to_frame(make_sequences(indexed, 2, features))
    runs = grid_search(spark, ready.where("seq < 250"), ready.where("seq >= 250"), 4, variant_configs())
    assert [r.config.split(",")[2] for r in runs.orderBy("run_id").collect()] == [
        "name=linear_basic", "name=linear_with_l1_reg", "name=linear_with_l2_reg", "name=linear_with_elastic_net",
    ]
    assert runs.where("test_loss IS NULL").count() == 0
