"""Metrics, rankings, importance and plot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.text import short_label
from gaugeframe.operators import importance, metrics, plotdata, ranking
from gaugeframe.operators.metrics import METRIC_NAMES
from gaugeframe.operators.scaling import fit_scaler, scale
from gaugeframe.queries import tables as t
from gaugeframe.queries.features import FEATURE_PARTS_SQL
from gaugeframe.queries.tables import r
from gaugeframe.session import materialize
from gaugeframe.sources.reports import type_results


def _regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.regression_metrics(t.predictions(spark, sf_dir))
    return table.select("model", *[r(c).alias(c) for c in METRIC_NAMES])


_METRIC_LIST = ", ".join(f"round({m}, 6) + 0e0 AS {m}" for m in METRIC_NAMES)
_REGRESSION_SQL = f"WITH {t.METRICS_SQL} SELECT model, {_METRIC_LIST} FROM metrics"


def _overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.regression_metrics(t.predictions(spark, sf_dir), groups=())
    return table.select(*[r(c).alias(c) for c in METRIC_NAMES])


_OVERALL_SQL = f"WITH {t.METRICS_SQL.replace('SELECT model, avg(error', 'SELECT avg(error').replace(' GROUP BY model)', ')')} SELECT {_METRIC_LIST} FROM metrics"


def _scaled_predictions(spark: SparkSession, sf_dir: str):
    rows = t.predictions(spark, sf_dir).select("file", F.col("ground_truth").alias("QoE"), "prediction")
    scaler = fit_scaler(rows, [])
    truth = scale(rows, scaler, ["QoE"]).select(F.col("QoE").alias("y"), "prediction")
    # The model's output lives in the scaled space of the target.
    return truth.select("y", (F.col("prediction") / 110.0).alias("prediction")), scaler


def _eval_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.eval_metrics_scaled(_scaled_predictions(spark, sf_dir)[0])
    return table.select(*[r(c, 8).alias(c) for c in table.columns])


_SCALED_SQL = t.PREDICTIONS_SQL + """, b AS (SELECT min(ground_truth) AS lo, max(ground_truth) AS hi FROM predictions),
    scored AS (SELECT (ground_truth - lo) / (hi - lo) AS y, prediction / 11e1 AS p, lo, hi FROM predictions, b)"""
_EVAL_SCALED_SQL = f"""WITH {_SCALED_SQL} SELECT round(avg((p - y) * (p - y)), 8) AS mse, round(avg(abs(p - y)), 8) AS mae,
    round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 8) + 0e0 AS r2 FROM scored"""


def _eval_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, scaler = _scaled_predictions(spark, sf_dir)
    table = metrics.eval_metrics_original(scored, scaler, "QoE")
    return table.select(*[r(c).alias(c) for c in table.columns])


_EVAL_ORIGINAL_SQL = f"""WITH {_SCALED_SQL}, o AS (SELECT y * (hi - lo) + lo AS y, p * (hi - lo) + lo AS p FROM scored)
    SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(min(y), 6) AS target_min,
      round(max(y), 6) AS target_max FROM o"""


def _file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.file_validation_metrics(t.predictions(spark, sf_dir))
    return table.select(*[r(c).alias(c) for c in table.columns])


_FILE_METRICS_SQL = f"""WITH {t.PREDICTIONS_SQL} SELECT round(avg(error * error), 6) AS mse, round(sqrt(avg(error * error)), 6) AS rmse,
    round(avg(abs(error)), 6) AS mae, round(1 - sum(error * error) / (count(*) * var_pop(ground_truth)), 6) AS r2,
    round(avg(error), 6) + 0e0 AS bias FROM errors"""


def _loss_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.predictions(spark, sf_dir).groupBy("model").agg(
        r(metrics.loss_mse(F.col("ground_truth"), F.col("prediction"))).alias("loss")
    )


_LOSS_MSE_SQL = f"WITH {t.PREDICTIONS_SQL} SELECT model, round(avg(error * error), 6) AS loss FROM errors GROUP BY model"


def _loss_log_cosh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.predictions(spark, sf_dir).groupBy("model").agg(
        r(metrics.loss_log_cosh(F.col("ground_truth"), F.col("prediction"))).alias("loss")
    )


_LOSS_LOG_COSH_SQL = f"""WITH {t.PREDICTIONS_SQL} SELECT model, round(avg(ln((exp(error) + exp(-error)) / 2e0)), 6) AS loss
    FROM errors GROUP BY model"""


def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.error_extent(t.predictions(spark, sf_dir))
    return table.select("model", r("low").alias("low"), r("high").alias("high"))


_EXTENT_SQL = f"""WITH {t.PREDICTIONS_SQL} SELECT model, round(least(min(ground_truth), min(prediction)), 6) AS low,
    round(greatest(max(ground_truth), max(prediction)), 6) AS high FROM predictions GROUP BY model"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_results(t.results_text(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.runs_text(spark, sf_dir).withColumn("test_loss", F.col("test_loss").try_cast("double"))


def _best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_config(_runs(spark, sf_dir))


_BEST_CONFIG_SQL = f"""WITH {t.RUNS_SQL} SELECT * FROM runs WHERE test_loss IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY test_loss, run_id) = 1"""


def _count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.count_by_type(_results(spark, sf_dir))


_COUNT_BY_TYPE_SQL = f"WITH {t.RESULTS_SQL} SELECT model_type, count(*) AS n_models FROM results GROUP BY model_type"


def _mean_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ranking.mean_by_type(_results(spark, sf_dir))
    return table.select("model_type", *[r(c, 8).alias(c) for c in table.columns if c != "model_type"])


_MEAN_BY_TYPE_SQL = f"""WITH {t.RESULTS_SQL} SELECT model_type, round(avg(mse), 8) AS avg_mse, round(avg(mae), 8) AS avg_mae,
    round(avg(r2), 8) AS avg_r2, round(avg(latency_ms), 8) AS avg_latency_ms FROM results WHERE mse IS NOT NULL GROUP BY model_type"""


def _rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_models(metrics.regression_metrics(t.predictions(spark, sf_dir), median=False))
    return ranked.select("model", "metric", r("value").alias("value"), F.col("rank").cast("bigint").alias("rank"))


_RANK_MODELS_SQL = f"""WITH {t.METRICS_SQL}, tall AS (
      SELECT model, 'r2' AS metric, r2 AS value, -r2 AS k FROM metrics UNION ALL SELECT model, 'rmse', rmse, rmse FROM metrics
      UNION ALL SELECT model, 'mae', mae, mae FROM metrics UNION ALL SELECT model, 'bias', abs(mean_error), abs(mean_error) FROM metrics)
    SELECT model, metric, round(value, 6) + 0e0 AS value, row_number() OVER (PARTITION BY metric ORDER BY k, model) AS rank FROM tall"""


def _top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = metrics.prediction_errors(t.predictions(spark, sf_dir))
    top = ranking.top_errors(errors, 10)
    return top.select("model", "file", r("error").alias("error"), "label", F.col("rank").cast("bigint").alias("rank"))


_TOP_ERRORS_SQL = f"""WITH {t.PREDICTIONS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY model
      ORDER BY abs(error) DESC, file, prediction) AS rank FROM errors)
    SELECT model, file, round(error, 6) + 0e0 AS error, CASE WHEN length(file) > 10 THEN substr(file, 1, 10) || '...' ELSE file END AS label,
      rank FROM x WHERE rank <= 10"""


def _top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.top5_by_metric(_results(spark, sf_dir))
    return top.select("model", "model_type", "metric", r("value", 8).alias("value"), F.col("rank").cast("bigint").alias("rank"))


_TALL_RESULTS = " UNION ALL ".join(
    f"SELECT model, model_type, '{m}' AS metric, {m} AS value, {'-' if high else ''}{m} AS k FROM results WHERE mse IS NOT NULL"
    for m, high in ranking.EVALUATION_METRICS.items()
)
_TOP5_SQL = f"""WITH {t.RESULTS_SQL}, tall AS ({_TALL_RESULTS}), x AS (
      SELECT *, row_number() OVER (PARTITION BY metric ORDER BY k, model) AS rank FROM tall)
    SELECT model, model_type, metric, round(value, 8) AS value, rank FROM x WHERE rank <= 5"""


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.composite_ranking(_results(spark, sf_dir), 5)
    return top.select("model", "model_type", r("composite_score", 8).alias("composite_score"))


_COMPOSITE_CTE = t.RESULTS_SQL + """, v AS (SELECT * FROM results WHERE mse IS NOT NULL), e AS (SELECT min(mse) a0, max(mse) a1,
      min(mae) b0, max(mae) b1, min(r2) c0, max(r2) c1, min(latency_ms) d0, max(latency_ms) d1 FROM v),
    s AS (SELECT model, model_type, 1 - (mse - a0) / (a1 - a0) AS mse_score, 1 - (mae - b0) / (b1 - b0) AS mae_score,
      (r2 - c0) / (c1 - c0) AS r2_score, 1 - (latency_ms - d0) / (d1 - d0) AS latency_ms_score FROM v, e),
    c AS (SELECT *, (mse_score + mae_score + r2_score + latency_ms_score) / 4e0 AS composite_score FROM s)"""
_COMPOSITE_SQL = f"""WITH {_COMPOSITE_CTE} SELECT model, model_type, round(composite_score, 8) AS composite_score FROM c
    ORDER BY c.composite_score DESC, model LIMIT 5"""


def _composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ranking.composite_scores(_results(spark, sf_dir))
    names = ("mse_score", "mae_score", "r2_score", "latency_ms_score", "composite_score")
    return table.select("model", *[r(c, 8).alias(c) for c in names])


_COMPOSITE_SCORES_SQL = f"""WITH {_COMPOSITE_CTE} SELECT model, {', '.join(f'round({c}, 8) AS {c}' for c in
    ('mse_score', 'mae_score', 'r2_score', 'latency_ms_score', 'composite_score'))} FROM c"""


def _best_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.best_by_validation_r2(metrics.regression_metrics(t.predictions(spark, sf_dir), median=False))
    return best.select("model", r("r2").alias("r2"))


_BEST_R2_SQL = f"WITH {t.METRICS_SQL} SELECT model, round(m.r2, 6) AS r2 FROM metrics m ORDER BY m.r2 DESC, model LIMIT 1"


def _combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of all model families, each cut from one stored table, stacked again."""
    extents = materialize(metrics.error_extent(t.predictions(spark, sf_dir)), "extents")
    parts = [extents.where(F.col("model").startswith(word)) for word in t.TYPE_WORDS]
    return ranking.combine_models(parts).select("model", r("low").alias("low"), r("high").alias("high"))


_COMBINE_SQL = _EXTENT_SQL


def _melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = ranking.melt_metrics(_results(spark, sf_dir), ["model"], ["mse", "mae", "r2", "latency_ms"])
    return tall.select("model", "metric", r("value", 8).alias("value"))


_MELT_SQL = f"""WITH {t.RESULTS_SQL} {' UNION ALL '.join(
    f"SELECT model, '{m}' AS metric, round({m}, 8) AS value FROM results" for m in ('mse', 'mae', 'r2', 'latency_ms'))}"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.prediction_errors(t.predictions(spark, sf_dir))
    return rows.select("model", "file", short_label(F.col("file")).alias("label"), r("error").alias("error"))


_ERRORS_SQL = f"""WITH {t.PREDICTIONS_SQL} SELECT model, file, CASE WHEN length(file) > 10 THEN substr(file, 1, 10) || '...' ELSE file END
    AS label, round(error, 6) + 0e0 AS error FROM errors"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = plotdata.error_histogram(metrics.prediction_errors(t.predictions(spark, sf_dir)))
    return table.select(
        "model", F.col("bin").cast("bigint").alias("bin"), r("bin_start").alias("bin_start"), r("bin_end").alias("bin_end"), "n_errors"
    )


_HISTOGRAM_SQL = f"""WITH {t.PREDICTIONS_SQL}, b AS (SELECT model, min(error) AS lo, max(error) AS hi FROM errors GROUP BY model),
    n AS (SELECT errors.model, least(floor((error - lo) / (hi - lo) * 3e1), 29)::BIGINT AS bin, count(*) AS n_errors
      FROM errors JOIN b ON errors.model = b.model GROUP BY 1, 2),
    f AS (SELECT b.*, bin FROM b, range(30) x(bin))
    SELECT f.model, f.bin::BIGINT AS bin, round(lo + f.bin * ((hi - lo) / 3e1), 6) AS bin_start,
      round(lo + (f.bin + 1) * ((hi - lo) / 3e1), 6) AS bin_end, coalesce(n_errors, 0) AS n_errors
    FROM f LEFT JOIN n ON f.model = n.model AND f.bin = n.bin"""


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = plotdata.error_density(metrics.prediction_errors(t.predictions(spark, sf_dir)), 50, 3.0)
    return table.select("model", F.col("point").cast("bigint").alias("point"), r("x").alias("x"), r("density", 9).alias("density"))


_DENSITY_SQL = f"""WITH {t.PREDICTIONS_SQL}, a AS (SELECT model, count(*) AS n, min(error) AS lo, max(error) AS hi,
      stddev_samp(error) * pow(count(*)::DOUBLE, -2e-1) AS h FROM errors GROUP BY model),
    g AS (SELECT model, n, h, point, lo - 3e0 * h + point * ((hi - lo + 6e0 * h) / 49e0) AS x FROM a, range(50) p(point))
    SELECT g.model, point::BIGINT AS point, round(x, 6) AS x,
      round(sum(exp(-5e-1 * ((x - error) / h) * ((x - error) / h))) / (any_value(n) * any_value(h) * sqrt(2e0 * pi())), 9) AS density
    FROM g JOIN errors ON g.model = errors.model GROUP BY g.model, point, x"""


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.model_comparison(t.predictions(spark, sf_dir)).select("model", "metric", r("value").alias("value"))


_COMPARISON_SQL = f"""WITH {t.METRICS_SQL} {' UNION ALL '.join(
    f"SELECT model, '{m}' AS metric, round({m}, 6) + 0e0 AS value FROM metrics" for m in ('mae', 'rmse', 'r2', 'mean_error'))}"""


def _roll(fn, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = fn(t.weights(spark, sf_dir))
        key = F.col(name).cast("bigint").alias(name) if name == "step" else F.col(name)
        return table.select(
            key, r("total_importance", 8).alias("total_importance"), "n_features", r("avg_importance").alias("avg_importance")
        )

    return run


def _roll_sql(name: str) -> str:
    return f"""WITH {t.WEIGHTS_SQL}, parts AS (SELECT *, {FEATURE_PARTS_SQL} FROM weights)
    SELECT {name}, round(sum(abs(weight)), 8) AS total_importance, count(*) AS n_features, round(avg(abs(weight)), 6) AS avg_importance
    FROM parts WHERE {name} IS NOT NULL GROUP BY {name}"""


def _top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = importance.top_features(t.weights(spark, sf_dir))
    return top.select("model_name", "feature", r("weight").alias("weight"), F.col("rank").cast("bigint").alias("rank"))


_TOP_FEATURES_SQL = f"""WITH {t.WEIGHTS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY model_name
      ORDER BY abs(weight) DESC, feature, weight) AS rank FROM weights)
    SELECT model_name, feature, round(weight, 6) + 0e0 AS weight, rank FROM x WHERE rank <= 10"""


def _rank_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = importance.rank_base_features(importance.importance_by_base(t.weights(spark, sf_dir)))
    return ranked.select("base_feature", r("avg_importance").alias("avg_importance"), F.col("rank").cast("bigint").alias("rank"))


_RANK_BASE_SQL = f"""WITH {t.WEIGHTS_SQL}, parts AS (SELECT *, {FEATURE_PARTS_SQL} FROM weights),
    a AS (SELECT base_feature, avg(abs(weight)) AS v FROM parts GROUP BY base_feature)
    SELECT base_feature, round(v, 6) AS avg_importance, row_number() OVER (ORDER BY v DESC, base_feature) AS rank FROM a"""


QUERIES = {
    "regression_metrics": (_regression, _REGRESSION_SQL),
    "regression_metrics_overall": (_overall, _OVERALL_SQL),
    "eval_metrics_scaled": (_eval_scaled, _EVAL_SCALED_SQL),
    "eval_metrics_original": (_eval_original, _EVAL_ORIGINAL_SQL),
    "file_validation_metrics": (_file_metrics, _FILE_METRICS_SQL),
    "loss_mse": (_loss_mse, _LOSS_MSE_SQL),
    "loss_log_cosh": (_loss_log_cosh, _LOSS_LOG_COSH_SQL),
    "error_extent": (_extent, _EXTENT_SQL),
    "best_config": (_best_config, _BEST_CONFIG_SQL),
    "count_by_type": (_count_by_type, _COUNT_BY_TYPE_SQL),
    "mean_by_type": (_mean_by_type, _MEAN_BY_TYPE_SQL),
    "rank_models": (_rank_models, _RANK_MODELS_SQL),
    "top_errors": (_top_errors, _TOP_ERRORS_SQL),
    "top5_by_metric": (_top5, _TOP5_SQL),
    "composite_ranking": (_composite, _COMPOSITE_SQL),
    "composite_scores": (_composite_scores, _COMPOSITE_SCORES_SQL),
    "best_by_validation_r2": (_best_r2, _BEST_R2_SQL),
    "combine_models": (_combine, _COMBINE_SQL),
    "melt_metrics": (_melt, _MELT_SQL),
    "prediction_errors": (_errors, _ERRORS_SQL),
    "error_histogram": (_histogram, _HISTOGRAM_SQL),
    "error_density": (_density, _DENSITY_SQL),
    "model_comparison": (_comparison, _COMPARISON_SQL),
    "importance_by_base": (_roll(importance.importance_by_base, "base_feature"), _roll_sql("base_feature")),
    "importance_by_step": (_roll(importance.importance_by_step, "step"), _roll_sql("step")),
    "importance_by_stat": (_roll(importance.importance_by_stat, "stat"), _roll_sql("stat")),
    "top_features": (_top_features, _TOP_FEATURES_SQL),
    "rank_base_features": (_rank_base, _RANK_BASE_SQL),
}
