"""Scaling, generation, models and streams."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.models import score, search, trees
from gaugeframe.models.frames import left_out, to_frame
from gaugeframe.models.linear import LinearModel, fit_linear, linear_importance
from gaugeframe.models.moments import Moments, moments, solve, squared_loss
from gaugeframe.models.nonlinear import fit_nonlinear
from gaugeframe.operators import features, generate, scaling, sequences
from gaugeframe.queries import modeling
from gaugeframe.schemas import feature_names
from gaugeframe.sources import sinks
from gaugeframe.streaming import score as stream_scoring
from gaugeframe.streaming import windows as stream_windowing


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e4, 1e4), st.floats(-1e4, 1e4)), min_size=2, max_size=30))
def test_scaling_round_trip(spark, values):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in values], "f0 double, QoE double")
    scaler = scaling.fit_scaler(rows, ["f0"])
    scaled = scaling.scale(rows, scaler, ["f0", "QoE"])
    assert all(-1e-9 <= v <= 1 + 1e-9 for r in scaled.collect() for v in r)
    back = scaling.inverse_scale(scaled, scaler, ["QoE"])
    assert sorted(r.QoE for r in back.collect()) == pytest.approx(sorted(float(b) for _, b in values), abs=1e-6)


def test_scaler_of_constant_and_missing(spark, tmp_path):
    rows = spark.createDataFrame([(5.0, 1.0, 10.0), (5.0, None, 20.0)], "f0 double, f1 double, QoE double")
    scaler = scaling.fit_scaler(rows, ["f0", "f1"])
    sinks.save_scaler(scaler, str(tmp_path / "s"))
    loaded = sinks.load_scaler(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in loaded.orderBy("pos").collect()] == [("f0", 0, 5.0, 5.0), ("f1", 1, 1.0, 1.0), ("QoE", 2, 10.0, 20.0)]
    got = [tuple(r) for r in scaling.scale(rows, loaded, ["f0", "f1", "QoE"]).orderBy("QoE").collect()]
    assert got == [(0.0, 0.0, 0.0), (0.0, None, 1.0)]
    new = spark.createDataFrame([(7.0,)], "f0 double")
    assert scaling.scale(new, loaded, ["f0"]).first().f0 == 2.0
    with pytest.raises(Exception, match="the scaler has no column f9"):
        scaling.scale(new.withColumn("f9", F.lit(1.0)), loaded, ["f0", "f9"]).collect()


def test_generated_windows(spark):
    starts = generate.window_starts(spark, "20250130065950", 40)
    made = generate.generate_windows(starts, seed=5)
    rows = made.orderBy("window_id").collect()
    assert rows[0].file == "20250130065958.json" and rows[1].file == "20250130070008.json"
    assert [s.key for s in rows[0].samples] == [f"202501300659{s}" for s in (50, 52, 54, 56, 58)]
    for r in rows:
        assert len(r.samples) == 5 and 0 <= r.QoE <= 100
        quality = []
        for s in r.samples:
            v, peak = s.v, int(s.key[8:10]) in (7, 8, 9, 17, 18, 19)
            assert 600 <= v.throughput <= 1600 and 0 <= v.packets_lost <= 5 and 0 <= v.packet_loss_rate <= 5
            assert 15 <= v.jitter <= (35 if peak else 30) and v.speed == int(v.speed) and 0 <= v.speed <= 60
            quality.append(95 - 4 * v.packet_loss_rate - 0.1 * v.jitter + (v.throughput - 600) / 200 - 0.05 * v.speed - 5 * peak)
        assert abs(r.QoE - np.mean(quality)) <= 1.0
    again = generate.generate_windows(starts.repartition(3), seed=5).orderBy("window_id").collect()
    assert rows == again
    assert generate.generate_windows(starts, seed=6).orderBy("window_id").collect() != rows
    assert generate.generate_windows(starts, inference=True).where("QoE IS NOT NULL").count() == 0
    frame = features.window_stats(features.flatten_samples(made))
    assert len(feature_names(stats=True)) == 45 and set(feature_names(stats=True)) <= set(frame.columns)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2, 2))
    y = x.reshape(400, 4) @ np.array([2.0, -1.0, 0.0, 0.5]) + 3.0 + rng.normal(0, 0.3, 400)
    rows = [(i, [[float(v) for v in s] for s in xi], float(yi)) for i, (xi, yi) in enumerate(zip(x, y))]
    return x.reshape(400, 4), y, spark.createDataFrame(rows, "seq long, X array<array<double>>, y double")


def reference_fit(x, y, l1, l2, steps=20000):
    """Proximal gradient for mean(e^2) + l1*sum|w| + l2*sum(w^2) with a free intercept."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    gram, c = xc.T @ xc / len(y), xc.T @ yc / len(y)
    rate = 0.4 / (np.linalg.eigvalsh(gram).max() + l2)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w = w - rate * (2 * (gram @ w - c) + 2 * l2 * w)
        w = np.sign(w) * np.maximum(abs(w) - rate * l1, 0)
    return w, y.mean() - x.mean(axis=0) @ w


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.0, 0.3), (0.4, 0.0), (0.2, 0.1)])
def test_linear_objective(spark, regression, l1, l2):
    x, y, rows = regression
    model = fit_linear(to_frame(rows), 4, l1, l2)
    w, b = reference_fit(x, y, l1, l2)
    assert model.coefficients.toArray() == pytest.approx(w, abs=1e-5)
    assert model.intercept == pytest.approx(b, abs=1e-5)


def test_moments_are_merged_in_one_pass(spark, regression):
    x, y, rows = regression
    far = rows.withColumn("X", F.transform("X", lambda s: F.transform(s, lambda v: v + 1e7))).withColumn("y", F.col("y") - 1e6)
    spoiled = spark.createDataFrame([(900, [[1.0, None], [1.0, 1.0]], 1.0), (901, [[1.0, 2.0], [1.0, 1.0]], None), (902, [[1.0, float("nan")], [1.0, 1.0]], 1.0)], rows.schema)
    frame = to_frame(far.unionByName(spoiled)).repartition(7)
    parts = moments(frame, 4, F.when(F.col("seq") % 10 < 8, "train").otherwise("test"))
    table = np.column_stack([x + 1e7, y - 1e6])
    kept = np.arange(400) % 10 < 8
    for part, own in (("train", kept), ("test", ~kept)):
        assert (parts[part].rows, parts[part].left_out) == (own.sum(), {"train": 3, "test": 0}[part])
        assert parts[part].mean == pytest.approx(table[own].mean(axis=0))
        assert parts[part].covariance == pytest.approx(np.cov(table[own].T, bias=True), abs=1e-6)
    w, b = solve(parts["train"], 0.1, 0.05)
    error = table[~kept][:, :4] @ w + b - table[~kept][:, 4]
    assert squared_loss(parts["test"], w, b) == pytest.approx((error**2).mean(), rel=1e-6)
    with pytest.raises(Exception, match="does not have 3 inputs"):
        moments(frame, 3)
    assert moments(frame.limit(0), 4) == {}


@pytest.mark.parametrize(("l1", "l2"), [(0.0, 0.0), (0.0, 0.2), (0.3, 0.0), (0.05, 0.05)])
def test_solutions_are_optimal(l1, l2):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 12)) * 10.0 ** rng.integers(-2, 3, 12)
    x[:, 5], x[:, 7] = 4.0, x[:, 6]
    y = x @ rng.normal(size=12) + rng.normal(size=300)
    table = np.column_stack([x, y])
    w, _ = solve(Moments(300, 0, table.mean(axis=0), np.cov(table.T, bias=True)), l1, l2)
    assert w[5] == 0.0
    e = y - y.mean() - (x - x.mean(axis=0)) @ w
    slope = -2 * (x - x.mean(axis=0)).T @ e / 300 + 2 * l2 * w
    scale = x.std(axis=0) * y.std() + 1e-12
    assert np.all(np.abs(np.where(w != 0, slope + l1 * np.sign(w), np.maximum(np.abs(slope) - l1, 0))) <= 1e-7 * scale + 1e-9)


def test_linear_grid_reads_its_rows_once(spark, regression):
    frame = to_frame(regression[2]).withColumn("part", F.when(F.col("seq") < 300, "train").otherwise("test"))
    configs = [*search.variant_configs(), *search.linear_configs([0.0, 0.5], [0.0, 1.0])]
    both = search.grid_search(spark, frame.where("part = 'train'").drop("part"), frame.where("part = 'test'").drop("part"), 4, configs)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    once = search.linear_grid(spark, frame.withColumn("y", counted("y")), F.col("part"), 4, configs)
    assert read.value == 400
    assert [r.test_loss for r in once.orderBy("run_id").collect()] == pytest.approx([r.test_loss for r in both.orderBy("run_id").collect()])
    lost = search.linear_grid(spark, frame.where("part = 'train'"), F.col("part"), 4, configs[:1]).first()
    assert lost.test_loss is None and "no rows" in lost.reason


def test_linear_importance(spark, regression):
    model = fit_linear(to_frame(regression[2]), 4)
    table = linear_importance(spark, model, ["a", "b"], 2).collect()
    assert [r.feature for r in table] == ["a_t-2", "b_t-2", "a_t-1", "b_t-1"]
    assert [r.weight for r in table] == pytest.approx(list(model.coefficients.toArray()))


def test_missing_values_are_kept_but_not_fitted(spark):
    rows = [(i, [[float(i)]], 2.0 * i + 1) for i in range(5)] + [(5, [[None]], 1.0), (6, [[6.0]], None), (7, None, 3.0)]
    frame = to_frame(spark.createDataFrame(rows, "i int, X array<array<double>>, y double"))
    assert tuple(left_out(frame).first()) == (5, 3)
    model = fit_linear(frame, 1)
    scored = {r.i: (r.prediction, r.reason) for r in score.score_sequences({"m": model}, frame).collect()}
    assert len(scored) == 8 and scored[5] == scored[7] == (None, "missing value")
    assert scored[6][0] == pytest.approx(13.0) and scored[6][1] is None
    assert score.evaluate_model(model, frame).first().mae == pytest.approx(0.0, abs=1e-6)
    assert model.getPredictionCol() == "prediction"


def test_iterative_solver_must_converge(spark, regression):
    frame = to_frame(regression[2])
    direct, stepwise = fit_linear(frame, 4), fit_linear(frame, 4, solver="l-bfgs")
    assert stepwise.coefficients.toArray() == pytest.approx(direct.coefficients.toArray(), abs=1e-4)
    with pytest.raises(RuntimeError, match="not converged"):
        fit_linear(frame, 4, solver="l-bfgs", max_iter=1)


def test_boosted_trees_stop_early(spark, regression):
    frame = to_frame(regression[2]).withColumn("held_out", F.col("seq") >= 320)
    model = fit_nonlinear(frame, max_iter=8, validation="held_out")
    assert 1 <= model.getNumTrees <= 8
    assert score.evaluate_model(model, frame).first().r2 > 0.3


def test_scoring_and_registry(spark, regression, tmp_path):
    _, _, rows = regression
    frame = to_frame(rows)
    models = {"linear_a": fit_linear(frame, 4), "linear_b": fit_linear(frame, 4, l2=1.0)}
    for name, model in models.items():
        score.save_model(spark, name, model, str(tmp_path))
    line = spark.createDataFrame([("gru_lost", str(tmp_path / "nowhere"), "GRU")], "model string, path string, model_type string")
    line.write.mode("append").parquet(str(tmp_path / "_registry"))
    loaded = score.load_models(spark, str(tmp_path))
    assert sorted(loaded) == ["linear_a", "linear_b"]
    assert list(score.load_models(spark, str(tmp_path), "linear_b")) == ["linear_b"]
    both = score.score_sequences(loaded, frame)
    assert both.groupBy("model").count().collect() and both.count() == 800
    direct = {r.seq: r.prediction for r in models["linear_b"].setPredictionCol("prediction").transform(frame).collect()}
    assert all(direct[r.seq] == r.prediction for r in both.where("model = 'linear_b'").collect())


def test_guard(spark, regression):
    assert score.guard_width(regression[2], 2).count() == 400
    with pytest.raises(Exception, match="expects 3 features"):
        score.guard_width(regression[2], 3).select("X").collect()


def test_attention_and_external(spark, regression):
    x, _, rows = regression
    rng = np.random.default_rng(3)
    w, b, u = rng.normal(size=(2, 5)), rng.normal(size=5), rng.normal(size=5)
    steps = x.reshape(400, 2, 2)
    logit = np.tanh(steps @ w + b) @ u
    share = np.exp(logit) / np.exp(logit).sum(axis=1, keepdims=True)
    want = (share[:, :, None] * steps).sum(axis=1)
    got = np.array([r.pooled for r in score.attention_pool(rows, w, b, u).orderBy("seq").collect()])
    assert got == pytest.approx(want)
    external = score.score_external(rows, lambda a: a.sum(axis=(1, 2)), 2, 2).orderBy("seq").collect()
    assert [r.prediction for r in external] == pytest.approx(list(x.sum(axis=1)))


def test_param_grid(spark):
    grid = search.param_grid(spark)
    assert grid.count() == 160 and grid.select("config_id").distinct().count() == 160
    assert {r.model_type: r["count"] for r in grid.groupBy("model_type").count().collect()} == {"lstm": 64, "gru": 64, "transformer": 32}


def test_grid_search_records_failures(spark, regression, tmp_path):
    frame = to_frame(regression[2])
    configs = [{"model_type": "linear", "l1": 0.0, "l2": p} for p in (0.0, 5.0)] + [{"model_type": "boosted", "max_depth": 99}]
    runs = search.grid_search(spark, frame.where("seq < 300"), frame.where("seq >= 300"), 4, configs, str(tmp_path / "runs"))
    table = {r.run_id: r.test_loss for r in runs.collect()}
    assert table[0] < table[1] and table[2] is None
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 3


def test_halving_keeps_the_best_third(spark, regression):
    frame = to_frame(regression[2])
    with pytest.raises(ValueError, match="grid_search"):
        search.successive_halving(spark, frame, frame, 4, search.linear_configs([0.0], [1.0]))
    configs = [{"model_type": "boosted", "max_depth": 3, "step": s} for s in (0.001, 0.5, 0.01, 0.1)]
    rows = search.successive_halving(spark, frame.where("seq < 300"), frame.where("seq >= 300"), 4, configs).collect()
    assert [(r.rung, r.kept) for r in rows] == [(0, True), (0, True), (0, False), (0, False), (1, True), (1, False), (2, True)]
    assert rows[-1].config == "max_depth=3,model_type=boosted,step=0.5" and [r.budget for r in rows] == [2] * 4 + [6] * 2 + [18]


def test_halving_goes_on_with_the_trees_it_has(spark, regression):
    frame = to_frame(regression[2])
    train, test = frame.where("seq < 300"), frame.where("seq >= 300")
    configs = [{"model_type": "boosted", "max_depth": 2, "step": 0.3}, {"model_type": "boosted", "max_depth": 99}]
    rows = search.successive_halving(spark, train, test, 4, configs, budget=1, factor=2).collect()
    assert [(r.rung, r.budget, r.fitted, r.kept, r.reason is None) for r in rows] == [(0, 1, 1, True, True), (0, 1, 1, False, False), (1, 2, 1, True, True)]
    # Two rungs of one tree are the two trees of one fit.
    once = search.successive_halving(spark, train, test, 4, configs[:1], budget=2).first()
    assert rows[-1].loss == pytest.approx(once.loss) and rows[-1].train_loss < rows[0].train_loss


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_settings_and_brackets_share_their_passes(spark, regression):
    frame = to_frame(regression[2])
    train, test = frame.where("seq < 300"), frame.where("seq >= 300")
    configs = [{"model_type": "boosted", "max_depth": 2, "step": s} for s in (0.5, 0.4, 0.3, 0.2, 0.1, 0.05)]

    def halved(n):
        return _jobs(spark, f"halving-{n}", lambda: search.successive_halving(spark, train, test, 4, configs[:n], budget=1, factor=6))

    # Both have a rung of one tree and one of six.
    assert halved(2) == halved(6) < 60
    space = {"max_depth": [2], "step": (0.1, 0.5, 0.1), "max_bins": [16]}
    one = _jobs(spark, "one", lambda: search.successive_halving(spark, train, test, 4, [{"model_type": "boosted", "max_depth": 2, "max_bins": 16}], budget=4))
    # Four trees are grown in either case; three brackets measure at two budgets more.
    assert _jobs(spark, "brackets", lambda: search.hyperband(spark, train, test, space, 4, 2)) <= one + 6


def _few_values(spark, rows=600):
    """Inputs of few values, so that every cut is a candidate."""
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, n, rows) for n in (5, 9, 3, 12)]).astype(float)
    y = np.sin(x[:, 0]) * x[:, 1] + (x[:, 2] > 1) * x[:, 3] + rng.normal(size=rows) / 3
    made = [(i, x[i].reshape(2, 2).tolist(), float(y[i])) for i in range(rows)]
    return to_frame(spark.createDataFrame(made, "seq int, X array<array<double>>, y double"))


def test_trees_are_those_of_the_tree_regressor(spark):
    frame = _few_values(spark).cache()
    train, test = frame.where("seq < 450"), frame.where("seq >= 450")
    configs = [{"model_type": "boosted", "max_depth": d, "step": s} for d, s in ((0, 0.5), (1, 0.5), (3, 0.3), (6, 0.2))]
    got = {config: losses for _, _, _, _, config, *losses, _, _ in search._brackets(train, test, [(configs, [search.Rung(0, 0, 3, 4, 1)])])}
    mean = train.agg(F.avg("y")).first()[0]
    for config in configs:
        table = frame.select("features", "seq", (F.col("y") - mean).alias("rest"))
        for _ in range(3):
            tree = DecisionTreeRegressor(featuresCol="features", labelCol="rest", predictionCol="tree", maxDepth=config["max_depth"], seed=0).fit(table.where("seq < 450"))
            table = tree.transform(table).withColumn("rest", F.col("rest") - config["step"] * F.col("tree")).drop("tree")
        want = {r.held_out: r.loss for r in table.groupBy((F.col("seq") >= 450).alias("held_out")).agg(F.avg(F.col("rest") * F.col("rest")).alias("loss")).collect()}
        train_loss, loss = got[f"max_depth={config['max_depth']},model_type=boosted,step={config['step']}"]
        assert train_loss == pytest.approx(want[False], rel=1e-9)
        # In nodes of few rows several cuts part the same rows, and rounding decides which is taken.
        assert loss == pytest.approx(want[True], rel=1e-9 if config["max_depth"] < 4 else 1e-3)


def test_passes_and_stored_rests_do_not_change_the_trees(spark, monkeypatch):
    frame = _few_values(spark)
    train, test = frame.where("seq < 450"), frame.where("seq >= 450")
    configs = [{"model_type": "boosted", "max_depth": d, "step": 0.3, "max_bins": b} for d, b in ((2, 16), (4, 300), (3, 8))]

    def losses():
        rows = search._brackets(train, test, [(configs, [search.Rung(0, 0, 1, 3, 2), search.Rung(0, 1, 3, 2, 1)])])
        return [(rung, config, kept) for _, rung, _, _, config, _, _, kept, _ in rows], [loss for row in rows for loss in row[5:7]]

    rows, want = losses()
    monkeypatch.setattr(trees, "CELLS", 150)
    monkeypatch.setattr(trees, "FOLD", 1)
    monkeypatch.setattr(trees, "VALUES", 40)
    again, got = losses()
    assert again == rows and got == pytest.approx(want, rel=1e-9)


def test_a_value_most_rows_share_can_be_cut_off(spark):
    made = [(i, [[10.0 if i % 40 else 0.001 * i]], float(bool(i % 40))) for i in range(4000)]
    frame = to_frame(spark.createDataFrame(made, "seq int, X array<array<double>>, y double"))
    row = search.successive_halving(spark, frame, frame, 1, [{"model_type": "boosted", "max_depth": 1, "step": 1.0, "max_bins": 8}], budget=1).first()
    assert row.loss == pytest.approx(0.0, abs=1e-12)


def test_halving_without_usable_rows_says_why(spark, regression):
    frame = to_frame(regression[2])
    test = frame.where("seq >= 300")
    configs = [{"model_type": "boosted"}, {"model_type": "boosted", "max_bins": 1}]
    for train, why in ((frame.where("seq < 0"), "no rows"), (frame.where("seq < 300").withColumn("y", F.when(F.col("seq") == 7, float("inf")).otherwise(F.col("y"))), "not finite")):
        rows = search.successive_halving(spark, train, test, 4, configs).collect()
        assert [r.loss for r in rows] == [None, None] and why in rows[0].reason and "max_bins 1" in rows[1].reason
    alone = search.successive_halving(spark, test, frame.where("seq < 0"), 4, configs[:1]).first()
    assert alone.loss is None and alone.reason is None and alone.train_loss > 0
    none = search.successive_halving(spark, test, test, 4, configs[:1], budget=0).first()
    assert none.train_loss == pytest.approx(none.loss) and none.fitted == 0


def test_hyperband_brackets():
    assert [(r.bracket, r.rung, r.budget, r.settings, r.kept) for r in search.hyperband_rungs(9, 3)] == [
        (0, 0, 1, 9, 3), (0, 1, 3, 3, 1), (0, 2, 9, 1, 1), (1, 0, 3, 5, 1), (1, 1, 9, 1, 1), (2, 0, 9, 3, 1),
    ]
    drawn = search.drawn_settings({"max_depth": (1, 3, 1), "step": (0.1, 0.5, 0.2), "max_bins": [8]}, 60, seed=4)
    assert {c["max_depth"] for c in drawn} == {1, 2, 3} and {c["step"] for c in drawn} == {0.1, 0.3, 0.5} and {c["max_bins"] for c in drawn} == {8}


def test_stream_windows_wait_for_the_watermark(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "ts timestamp, jitter double"

    def add(*rows):
        spark.createDataFrame(rows, "t string, jitter double").select(F.col("t").cast("timestamp").alias("ts"), "jitter").coalesce(
            1
        ).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        made = stream_windowing.stream_windows(stream, metrics=("jitter",))
        stream_windowing.run_available(made, out).awaitTermination()
        return {str(r.window_start)[-8:]: (r.n_samples, r.jitter_mean) for r in stream_windowing.read_output(spark, made, out).collect()}

    add(("2025-01-01 00:00:01", 1.0), ("2025-01-01 00:00:04", 3.0), ("2025-01-01 00:00:12", 5.0))
    assert run() == {}
    add(("2025-01-01 00:01:00", 9.0),)
    assert run() == {"00:00:00": (2, 2.0), "00:00:10": (1, 5.0)}
    add(("2025-01-01 00:00:05", 100.0), ("2025-01-01 00:02:00", 4.0))
    assert run() == {"00:00:00": (2, 2.0), "00:00:10": (1, 5.0), "00:01:00": (1, 9.0)}


def test_stream_score_carries_history(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    schema = "key string, t int, x double"

    def add_and_run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        mean = lambda df: sequences.mean_pool(df, 1).select("key", "t", F.get("pooled", F.lit(0)).alias("p"))
        stream_scoring.stream_score(stream, out, ["key"], ["t"], ["x"], 3, mean).awaitTermination()
        return {(r.key, r.t): r.p for r in stream_scoring.read_scores(spark, out).collect()}

    assert add_and_run(("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 10.0)) == {}
    assert add_and_run(("a", 3, 6.0), ("b", 2, 20.0)) == {("a", 3): 3.0}
    # The row at t = 2 is late and changes nothing.
    got = add_and_run(("a", 2, 99.0), ("a", 4, 7.0), ("b", 3, 60.0), ("c", 1, 0.0))
    assert got == {("a", 3): 3.0, ("a", 4): 5.0, ("b", 3): 30.0}
    late = stream_scoring.read_late(spark, out).collect()
    assert [(r.key, r.t, r.x, r.reason) for r in late] == [("a", 2, 99.0, stream_scoring.LATE)]


def test_linear_prediction_makes_its_inputs_once(spark):
    model = LinearModel(tuple(float(i) for i in range(1, 26)), 0.5)
    assert str(model.prediction(F.flatten("X"))).count("flatten") == 1
    rows = spark.createDataFrame([(0, [1.0] * 25), (1, [1.0] * 26), (2, [1.0] * 24), (3, None)], "i int, v array<double>")
    got = {r.i: r.p for r in rows.select("i", model.prediction(F.col("v")).alias("p")).collect()}
    assert got == {0: 325.5, 1: 325.5, 2: None, 3: None}
    assert spark.range(1).select(LinearModel((), 0.5).prediction(F.array(F.lit(1.0)))).first()[0] == 0.5


class _Held(dict):
    def getValue(self, key):  # noqa: N802
        return self.get(key)

    updateValue = dict.__setitem__  # noqa: N815


def test_stream_state_serves_all_series_of_a_group():
    state = T.StructType().add("key", "string").add("t", "long").add("x", "double")
    processor = stream_scoring.LastRows(["key"], ["t"], ["x"], 2, state, None)
    processor.held = _Held()

    def call(*rows):
        names = [*state.names, stream_scoring._NULLS]
        (out,) = processor.handleInputRows((0,), iter([pd.DataFrame([row], columns=names) for row in rows]), None)
        return [tuple(row) for row in out.itertuples(index=False)]

    assert call(("a", 2, 5.0, 0), ("b", 1, 7.0, 0), ("a", 1, 3.0, 0)) == [
        ("a", 1, 3.0, None, None), ("a", 2, 5.0, [[3.0], [5.0]], None), ("b", 1, 7.0, None, None)
    ]
    assert processor.held == {("a",): ([("a", 2, 5.0)],), ("b",): ([("b", 1, 7.0)],)}
    assert call(("b", 2, 0.0, 4), ("a", 1, 9.0, 0)) == [
        ("b", 2, None, [[7.0], [None]], None), ("a", 1, 9.0, None, stream_scoring.LATE)
    ]


def test_stream_score_keeps_keys_beside_null_ones(spark, tmp_path):
    source, out, schema = str(tmp_path / "in"), str(tmp_path / "run"), "key long, t int, x double"
    mean = lambda df: sequences.mean_pool(df, 1).select("key", "t", F.get("pooled", F.lit(0)).alias("p"))
    far = 2**53 + 1
    for rows in ([(far, 1, 1.0), (None, 1, 10.0), (0, 1, 5.0)], [(far, 2, 2.0), (None, 2, 20.0), (far - 1, 2, 0.0), (0, None, 6.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_scoring.stream_score(stream, out, ["key"], ["t"], ["x"], 2, mean).awaitTermination()
    assert {(r.key, r.t): r.p for r in stream_scoring.read_scores(spark, out).collect()} == {(far, 2): 1.5, (None, 2): 15.0}
    assert [(r.key, r.t, r.x) for r in stream_scoring.read_late(spark, out).collect()] == [(0, None, 6.0)]


def test_the_registered_search_is_whole(spark, monkeypatch, tmp_path):
    """All inputs at five steps, twenty trees by thirds, and ranges as wide as those searched for networks."""
    seen = {}

    def hyperband(spark, train, test, space, largest, factor):
        seen.update(width=len(train.first()["X"]), space=space, rungs=search.hyperband_rungs(largest, factor))
        return spark.createDataFrame([], search.HALVING)

    rows = [(i, datetime(2024, 1, 1, 0, i), i % 3, "view", float(i), '{"k": %d}' % i) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(search, "hyperband", hyperband)
    modeling.QUERIES["successive_halving"][0](spark, str(tmp_path)).collect()
    assert seen["width"] == 5
    assert [(r.bracket, r.budget, r.settings) for r in seen["rungs"]] == [(0, 2, 9), (0, 6, 3), (0, 20, 1), (1, 6, 5), (1, 20, 1), (2, 20, 3)]
    values = {name: round((high - low) / step) + 1 for name, (low, high, step) in seen["space"].items()}
    assert values == {"max_depth": 4, "step": 5, "max_bins": 4}


def test_rows_go_through_small_and_large_trees_alike(monkeypatch):
    rng = np.random.default_rng(3)
    tree = trees.Tree([0, 2, 0, 1, 0, 0, 0], [4, 3, 1 << 40, 2, 1 << 40, 1 << 40, 1 << 40], [1, 3, 2, 5, 4, 5, 6], [0.0] * 7, 3)
    bins = rng.integers(0, 9, (3, 500), dtype=np.uint8)
    small = trees._place(bins, tree.arrays())
    monkeypatch.setattr(trees, "SMALL", 0)
    assert small.tolist() == trees._place(bins, tree.arrays()).tolist() and set(small.tolist()) == {2, 4, 5, 6}
