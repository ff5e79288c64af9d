"""Metrics, rankings and plot tables against NumPy and published numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import importance, lookups, metrics, plotdata, profile, ranking
from gaugeframe.sources import reports, sinks

# A published evaluation table (model, type, MSE, MAE, R2, latency in ms).
EVALUATIONS = """
dnn_basic.h5,SimpleDNN,0.0929,0.2572,-0.0172,54.65
dnn_deep.h5,SimpleDNN,0.1126,0.2981,-0.2326,53.85
dnn_with_elu.h5,SimpleDNN,0.1040,0.2760,-0.1384,54.25
dnn_with_high_dropout.h5,SimpleDNN,0.1371,0.3210,-0.5003,54.49
gru_basic.h5,GRU,0.1067,0.2890,-0.1680,63.72
gru_deep.h5,GRU,0.0943,0.2497,-0.0317,67.24
gru_wide.h5,GRU,0.1359,0.3324,-0.4875,65.49
gru_with_stats.h5,GRU,0.0921,0.2527,-0.0080,66.04
linear_basic.h5,LinearRegressor,0.1496,0.3215,-0.6379,57.03
linear_with_elastic_net.h5,LinearRegressor,0.1626,0.3214,-0.7799,56.41
linear_with_l1_reg.h5,LinearRegressor,0.1395,0.3178,-0.5265,56.55
linear_with_l2_reg.h5,LinearRegressor,0.1495,0.2978,-0.6366,57.42
lstm_basic.h5,LSTM,0.1032,0.2849,-0.1292,66.27
lstm_deep.h5,LSTM,0.1079,0.2932,-0.1810,67.73
lstm_wide.h5,LSTM,0.0964,0.2730,-0.0551,66.55
lstm_with_stats.h5,LSTM,0.0938,0.2645,-0.0272,65.65
transformer_basic.h5,Transformer,0.1107,0.2499,-0.2114,59.64
transformer_large_ff.h5,Transformer,0.1186,0.3078,-0.2981,60.49
transformer_low_dropout.h5,Transformer,0.0987,0.2718,-0.0802,59.73
transformer_more_heads.h5,Transformer,0.0848,0.2472,0.0714,59.84
transformer_with_stats.h5,Transformer,0.1203,0.2580,-0.3170,59.77
""".strip()


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "results.csv"
    header = "Model,Model Type,MSE,MAE,R2,Inference Latency (ms)"
    path.write_text(f"{header}\n{EVALUATIONS}\nbroken.h5,ERROR,null,null,null,null\n")
    return reports.scan_results_csv(spark, str(path))


def test_results_csv(results):
    assert results.count() == 22
    assert results.where("mse IS NULL").select("model", "model_type").collect() == [("broken.h5", "ERROR")]


def test_composite_ranking(results):
    top = ranking.composite_ranking(results).collect()
    assert [(r.model, round(r.composite_score, 4)) for r in top] == [
        ("dnn_basic.h5", 0.9042), ("transformer_more_heads.h5", 0.8921), ("dnn_with_elu.h5", 0.7850),
        ("transformer_low_dropout.h5", 0.7327), ("transformer_basic.h5", 0.7215),
    ]


def test_composite_of_equal_values(spark):
    rows = spark.createDataFrame(
        [("a", "t", 1.0, 2.0, 0.5, 3.0), ("b", "t", 1.0, 1.0, 0.5, 3.0)],
        "model string, model_type string, mse double, mae double, r2 double, latency_ms double",
    )
    got = {r.model: r.composite_score for r in ranking.composite_scores(rows).collect()}
    assert got == {"a": 0.75, "b": 1.0}


def test_top5(results):
    top = ranking.top5_by_metric(results).orderBy("metric", "rank").collect()
    names = lambda m: [r.model.removesuffix(".h5") for r in top if r.metric == m]
    assert names("mse") == ["transformer_more_heads", "gru_with_stats", "dnn_basic", "lstm_with_stats", "gru_deep"]
    assert names("mae") == ["transformer_more_heads", "gru_deep", "transformer_basic", "gru_with_stats", "dnn_basic"]
    assert names("r2") == ["transformer_more_heads", "gru_with_stats", "dnn_basic", "lstm_with_stats", "gru_deep"]
    assert names("latency_ms") == ["dnn_deep", "dnn_with_elu", "dnn_with_high_dropout", "dnn_basic", "linear_with_elastic_net"]


def test_counts_and_means_by_type(results):
    counts = {r.model_type: r.n_models for r in ranking.count_by_type(results).collect()}
    assert counts == {"Transformer": 5, "SimpleDNN": 4, "GRU": 4, "LinearRegressor": 4, "LSTM": 4, "ERROR": 1}
    means = {r.model_type: tuple(round(v, 6) for v in list(r)[1:]) for r in ranking.mean_by_type(results).collect()}
    assert means == {
        "GRU": (0.10725, 0.28095, -0.1738, 65.6225), "LSTM": (0.100325, 0.2789, -0.098125, 66.55),
        "LinearRegressor": (0.1503, 0.314625, -0.645225, 56.8525), "SimpleDNN": (0.11165, 0.288075, -0.222125, 54.31),
        "Transformer": (0.10662, 0.26694, -0.16706, 59.894),
    }


def frame(spark, groups):
    rows = [(m, f"{m}{i}.json", float(y), float(p)) for m, (ys, ps) in groups.items() for i, (y, p) in enumerate(zip(ys, ps))]
    return spark.createDataFrame(rows, "model string, file string, ground_truth double, prediction double")


def test_regression_metrics(spark):
    rng = np.random.default_rng(4)
    y = rng.uniform(0, 100, 501)
    groups = {"noisy": (y, y + rng.normal(3, 8, 501)), "even": (y[:10], rng.uniform(0, 100, 10))}
    got = {r.model: r.asDict() for r in metrics.regression_metrics(frame(spark, groups)).collect()}
    for name, (t, p) in groups.items():
        e = p - t
        want = {
            "mse": (e**2).mean(), "rmse": np.sqrt((e**2).mean()), "mae": abs(e).mean(), "medae": np.median(abs(e)),
            "r2": 1 - (e**2).sum() / ((t - t.mean()) ** 2).sum(), "explained_variance": 1 - e.var() / t.var(),
            "mean_error": e.mean(), "max_error": abs(e).max(), "min_error": abs(e).min(),
        }
        assert {k: got[name][k] for k in want} == pytest.approx(want)


def test_regression_metrics_of_degenerate_groups(spark):
    groups = {"one": ([5], [6]), "constant": ([2, 2, 2], [1, 2, 4]), "perfect": ([2, 2], [2, 2]), "shifted": ([2, 2], [3, 3])}
    got = {r.model: (r.r2, r.explained_variance) for r in metrics.regression_metrics(frame(spark, groups)).collect()}
    assert got == {"one": (None, 1.0), "constant": (0.0, 0.0), "perfect": (1.0, 1.0), "shifted": (0.0, 1.0)}
    near = metrics.regression_metrics(frame(spark, {"m": ([1, 2, 3, 4], [1, 3, 3, 6])}), approximate_median=True).first()
    assert near.medae in (0.0, 1.0)


def test_rank_models_ties_go_by_name(spark):
    table = metrics.regression_metrics(frame(spark, {"b": ([1, 2], [2, 3]), "a": ([1, 2], [2, 3]), "c": ([1, 2], [1, 2])}))
    ranks = {(r.metric, r.model): r.rank for r in ranking.rank_models(table).collect()}
    assert [m for m in "abc" if ranks["r2", m] == 1] == ["c"]
    assert (ranks["rmse", "a"], ranks["rmse", "b"]) == (2, 3)
    assert ranking.best_by_validation_r2(table).first().model == "c"


def test_top_errors(spark):
    rows = metrics.prediction_errors(frame(spark, {"m": (range(30), [2 * v * (-1) ** v for v in range(30)])}))
    top = ranking.top_errors(rows, 3).orderBy("rank").collect()
    assert [abs(r.error) for r in top] == [87.0, 81.0, 75.0] and top[0].label == "m29.json"


def test_best_config_takes_the_first_of_ties(spark):
    runs = spark.createDataFrame(
        [(2, "gru", 0.1), (1, "gru", 0.1), (3, "gru", None), (4, "lstm", 0.3), (5, "lstm", 0.2), (6, "dnn", None)],
        "run_id int, model_type string, test_loss double",
    )
    assert {(r.model_type, r.run_id) for r in ranking.best_config(runs).collect()} == {("gru", 1), ("lstm", 5)}


def test_histogram(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=400)
    rows = spark.createDataFrame([("m", float(v)) for v in e] + [("level", 2.0)] * 4 + [("level", None)], "model string, error double")
    got = plotdata.error_histogram(rows).orderBy("model", "bin").collect()
    counts, edges = np.histogram(e, 30)
    assert [r.n_errors for r in got if r.model == "m"] == list(counts)
    assert [r.bin_start for r in got if r.model == "m"] == pytest.approx(list(edges[:-1]))
    assert [r.n_errors for r in got if r.model == "level"] == list(np.histogram([2.0] * 4, 30)[0])


def test_density(spark):
    rng = np.random.default_rng(6)
    e = np.concatenate([rng.normal(0, 1, 200), rng.normal(500, 0.1, 50)])
    rows = spark.createDataFrame([("m", float(v)) for v in e] + [("one", 1.0)], "model string, error double")
    got = plotdata.error_density(rows, 40, 3.0).orderBy("point").collect()
    h = e.std(ddof=1) * len(e) ** -0.2
    grid = np.linspace(e.min() - 3 * h, e.max() + 3 * h, 40)
    want = np.exp(-0.5 * ((grid[:, None] - e) / h) ** 2).sum(axis=1) / (len(e) * h * np.sqrt(2 * np.pi))
    assert {r.model for r in got} == {"m"}
    assert [r.x for r in got] == pytest.approx(list(grid))
    assert [r.density for r in got] == pytest.approx(list(want))


def test_density_far_from_the_errors_is_zero(spark):
    rows = spark.createDataFrame([("m", v) for v in [0.0] * 4000 + [1e-3] * 4000 + [1e5]], "model string, error double")
    got = plotdata.error_density(rows, 9).orderBy("point").collect()
    assert len(got) == 9 and got[4].density == 0.0 and got[0].density > 0


def test_importance_roll_ups(spark):
    rows = spark.createDataFrame(
        [("m", "jitter_mean_t-2", 0.5), ("m", "jitter_mean_t-1", -1.5), ("m", "f0_t-2", 0.1), ("m", "speed_max", -2.0)],
        "model_name string, feature string, weight double",
    )
    table = lambda fn: {r[0]: (r.n_features, r.avg_importance) for r in fn(rows).collect()}
    assert table(importance.importance_by_base) == {"jitter_mean": (2, 1.0), "f0": (1, 0.1), "speed": (1, 2.0)}
    assert table(importance.importance_by_step) == {2: (2, 0.3), 1: (1, 1.5)}
    assert table(importance.importance_by_stat) == {"_mean": (2, 1.0), "_max": (1, 2.0)}
    steps = importance.rank_steps(importance.importance_by_step(rows)).collect()
    assert [r.step for r in steps] == [2, 1]
    assert [r.feature for r in importance.top_features(rows, 2).orderBy("rank").collect()] == ["speed_max", "jitter_mean_t-1"]


def test_logs(spark, tmp_path):
    good = (
        "Detected model type: Simple DNN\nMean Squared Error (MSE): 0.0929\nMean Absolute Error (MAE): 0.2572\nR^2 Score: -0.0172\n"
        "Mean Squared Error (MSE): 900.1\nAverage Inference Latency on Current System: 54.65 ms\nTest Loss: 0.3\nTest Loss: x\n"
    )
    (tmp_path / "good").write_text(good)
    (tmp_path / "cut").write_text("\r\n".join(good.split("\n")[:3]) + "\r\nTest Loss: 0.25\r\n")
    (tmp_path / "bad").write_text("Detected model type: LSTM\nValueError: no file\n")
    lines = reports.scan_log_lines(spark, str(tmp_path))
    got = {r.model: tuple(r)[1:-1] for r in reports.extract_log_metrics(lines).collect()}
    logs = reports.scan_logs(spark, str(tmp_path))
    assert {r.model: tuple(r)[1:-1] for r in reports.log_metrics(logs).collect()} == got
    assert {r.model: r.error for r in reports.log_metrics(logs).collect()} == {"good": None, "cut": None, "bad": "ValueError: no file"}
    plan = reports.log_metrics(logs)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert {r.file: r.test_loss for r in reports.log_test_loss(logs).collect()} == {"good": None, "cut": 0.25, "bad": None}
    assert got == {
        "good": ("SimpleDNN", 0.0929, 0.2572, -0.0172, 54.65, "OK"),
        "cut": ("SimpleDNN", None, None, None, None, "INCOMPLETE METRICS"),
        "bad": ("ERROR", None, None, None, None, "FAILED"),
    }
    losses = {r.file: r.test_loss for r in reports.extract_test_loss(lines).collect()}
    assert losses == {"good": None, "cut": 0.25, "bad": None}


def test_importance_files(spark, tmp_path):
    (tmp_path / "a.importance.json").write_text(
        '{"model_name": "a", "model_type": "Linear Regressor", "feature_importance": [{"feature": "f1_t-1", "weight": -0.5}], "bias": 0.1}'
    )
    (tmp_path / "b.importance.json").write_text('{"model_name": "b", ')
    (tmp_path / "other.json").write_text("{}")
    assert [tuple(r) for r in reports.scan_importance(spark, str(tmp_path)).collect()] == [("a", 0.1, 0, "f1_t-1", -0.5)]


def test_validation_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"creation_timestamp": "1", "files": {"a.json": {"ground_truth_qoe": 4.5}}, "format": "new", "sample_ratio": 1.0, "random_seed": null}'
    )
    assert [tuple(r) for r in reports.scan_validation_metadata(spark, str(tmp_path / "m.json")).collect()] == [("a.json", 4.5, "new")]


def test_results_written(spark, tmp_path):
    preds = metrics.prediction_errors(frame(spark, {"a": ([1, 2], [1, 3]), "b": ([1, 2], [0, 0])}))
    sinks.sink_results_csv(metrics.regression_metrics(preds), preds, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out" / "detailed_results").glob("model=*")) == ["model=a", "model=b"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "validation_summary")).count() == 2


def test_file_status(spark):
    rows = spark.createDataFrame([(f"2025-01-01 00:00:0{i}", i) for i in range(6)], "t string, idx long").withColumn(
        "ts", F.col("t").cast("timestamp")
    )
    files = spark.createDataFrame([(f"2025010100000{i}.json",) for i in range(8)], "file string")
    status = lookups.file_status(files, files.where("file <> '20250101000004.json'"), rows, 3)
    got = {r.file[13:14]: r.reason for r in status.collect()}
    assert got == {"0": lookups.SHORT_HISTORY, "1": lookups.SHORT_HISTORY, "2": None, "3": None, "4": lookups.NOT_IN_METADATA,
                   "5": None, "6": lookups.NO_ROW, "7": lookups.NO_ROW}
    assert {r.reason: r.n_files for r in lookups.skipped_files(status).collect()} == {
        lookups.SHORT_HISTORY: 2, lookups.NOT_IN_METADATA: 1, lookups.NO_ROW: 2
    }


def test_profile(spark):
    rng = np.random.default_rng(8)
    values = {"a": rng.lognormal(size=300), "b": np.zeros(5)}
    rows = spark.createDataFrame([(m, float(v)) for m, vs in values.items() for v in vs], "metric string, value double")
    got = {r.metric: r.asDict() for r in profile.dataset_profile(rows).collect()}
    a = values["a"]
    want = {"min": a.min(), "max": a.max(), "mean": a.mean(), "median": np.median(a), "std": a.std(), "p25": np.percentile(a, 25),
            "p75": np.percentile(a, 75), "cv": a.std() / a.mean()}
    assert {k: got["a"][k] for k in want} == pytest.approx(want)
    assert got["b"]["cv"] is None
    assert profile.dataset_profile(rows, approximate=True).count() == 2


def test_span(spark):
    rows = spark.createDataFrame([("2025-04-02 12:19:54",), ("2025-04-02 13:50:38",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    row = profile.dataset_span(rows).first()
    assert (row.n_files, row.span_seconds) == (2, 5444) and row.estimated_hours == pytest.approx(10 / 3600)


def test_groups_without_a_name_have_their_errors(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 4.0), ("m", 0.0), ("m", 1.0)], "model string, error double")
    bins = plotdata.error_histogram(rows, bins=3).where("model is null").orderBy("bin").collect()
    assert [r.n_errors for r in bins] == [1, 1, 1]
    density = plotdata.error_density(rows, points=5).where("model is null").collect()
    assert len(density) == 5 and all(r.density > 0 for r in density)


def test_no_median_unless_asked(spark):
    table = metrics.regression_metrics(frame(spark, {"m": ([1, 2, 3], [1, 3, 3])}), median=False)
    assert "medae" not in table.columns and table.first().mae == pytest.approx(1 / 3)
