"""Sources and sinks. File round trips go through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import try_double
from gaugeframe.functions.timeparse import ts_digits
from gaugeframe.operators.clean import repair_counts, repair_types
from gaugeframe.operators.metrics import prediction_errors, regression_metrics
from gaugeframe.operators.scaling import fit_scaler, scale
from gaugeframe.queries import tables as t
from gaugeframe.queries.tables import r
from gaugeframe.schemas import EXPERIMENT_SCHEMA, FLAT_METRICS, METRICS, TARGET
from gaugeframe.session import scratch_path
from gaugeframe.sources import reports, sinks
from gaugeframe.sources.windows import collapse_documents, flat_from_text, scan_windows, to_flat, to_windows, with_document


def _sample_sums(layout: str) -> list:
    names = METRICS[layout]
    total = lambda m: F.aggregate(
        "samples", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["v"][m], F.lit(0.0))
    )
    return [r(total(m), 4).alias(f"sum_{m}") for m in names]


def _scan(layout: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = to_windows(t.documents(spark, sf_dir, layout), layout)
        return parsed.select(
            "window_id", "file", "ts_raw", ts_digits(F.col("ts")).alias("ts_text"), r(TARGET, 9).alias(TARGET),
            F.coalesce(F.size("samples"), F.lit(0)).cast("bigint").alias("n_samples"),
            F.get("samples", F.lit(0))["key"].alias("first_key"),
            *_sample_sums(layout),
        )

    return run


def _scan_sql(layout: str) -> str:
    sums = ", ".join(
        f"CASE WHEN NOT broken THEN round(coalesce(sum(s.{m}), 0), 4) END AS sum_{m}" for m in METRICS[layout]
    )
    return f"""WITH {t.DOCS_SQL}
    SELECT d.window_id, d.file, d.ts_raw, d.ts_raw AS ts_text, round(d."QoE", 9) AS "QoE", count(s.key) AS n_samples,
      min(s.key) AS first_key, {sums}
    FROM docs d LEFT JOIN doc_samples s ON d.window_id = s.window_id
    GROUP BY d.window_id, d.file, d.ts_raw, d."QoE", d.broken"""


def _scan_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse_documents(with_document(t.documents(spark, sf_dir)))
    return rows.select("window_id", "ts_raw", r(TARGET, 9).alias(TARGET), *FLAT_METRICS)


_MEANS = ", ".join(f"list_sum(list({m} ORDER BY key)) / count({m}) AS raw_{m}" for m in FLAT_METRICS)
_ROUNDED = ", ".join(f"{t.sql_round(f'raw_{m}', 2)} AS {m}" for m in FLAT_METRICS)
_SCAN_MEAN_SQL = f"""WITH {t.DOCS_SQL},
    means AS (SELECT window_id, {_MEANS} FROM doc_samples GROUP BY window_id)
    SELECT d.window_id, d.ts_raw, round(d."QoE", 9) AS "QoE", {_ROUNDED}
    FROM docs d LEFT JOIN means m ON d.window_id = m.window_id"""


def _scan_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_flat(flat_from_text(t.flat_records(spark, sf_dir)).withColumnRenamed("event_id", "file"))
    return rows.select(
        F.col("file").alias("event_id"), *FLAT_METRICS, TARGET, ts_digits(F.col("ts")).alias("ts_text"),
        *[F.col(c).cast("bigint").alias(c) for c in ("hour", "minute", "day_of_week")],
    )


_SCAN_FLAT_SQL = f"""WITH {t.FLAT_SQL}
    SELECT event_id, packet_loss_rate, jitter, throughput, speed, "QoE", strftime(ts, '%Y%m%d%H%M%S') AS ts_text,
      hour(ts)::BIGINT AS hour, minute(ts)::BIGINT AS minute, (isodow(ts) - 1)::BIGINT AS day_of_week
    FROM flat"""


def _scan_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_flat(flat_from_text(t.flat_records(spark, sf_dir)).withColumnRenamed("event_id", "file"))
    return rows.where(F.col(TARGET).isNull()).select(F.col("file").alias("event_id"), *FLAT_METRICS)


_SCAN_INFERENCE_SQL = f"""WITH {t.FLAT_SQL}
    SELECT event_id, packet_loss_rate, jitter, throughput, speed FROM flat WHERE "QoE" IS NULL"""


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.windows(spark, sf_dir).select(
        F.concat(
            F.lit('{"creation_timestamp":"20240101000000","format":"new","sample_ratio":1.0,"random_seed":null,"files":{"'),
            F.col("window_id").cast("string"), F.lit('_a.json":{"ground_truth_qoe":'), F.round(TARGET, 9).cast("string"),
            F.lit('},"'), F.col("window_id").cast("string"), F.lit('_b.json":{"ground_truth_qoe":null}}}'),
        ).alias("value")
    )
    return reports.metadata_from_text(docs)


_METADATA_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT window_id::VARCHAR || '_a.json' AS file, round("QoE", 9) AS ground_truth_qoe, 'new' AS format FROM windows
    UNION ALL SELECT window_id::VARCHAR || '_b.json', NULL, 'new' FROM windows"""


def _results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    t.results_text(spark, sf_dir).write.option("header", True).csv(path)
    return reports.scan_results_csv(spark, path)


_RESULTS_SQL = f"WITH {t.RESULTS_SQL} SELECT * FROM results"

_RUN_COLUMNS = ("model_type", "seq_length", "hidden_units", "num_layers", "dropout_rate", "learning_rate",
                "bidirectional", "num_heads", "ff_dim", "test_loss")


def _experiments_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "experiments")
    output = F.concat(F.lit('line one, "quoted"\nrun '), F.col("run_id").cast("string"))
    t.runs_text(spark, sf_dir).select(*_RUN_COLUMNS, output.alias("run_output")).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    return reports.scan_experiments_csv(spark, path).withColumn("run_output", F.split_part("run_output", F.lit("run "), F.lit(2)))


_EXPERIMENTS_SQL = f"WITH {t.RUNS_SQL} SELECT {', '.join(_RUN_COLUMNS)}, run_id::VARCHAR AS run_output FROM runs"


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("feature", "weight")
    other = F.struct(F.concat(F.lit("copy_"), F.col("feature")).alias("feature"), (-F.col("weight")).alias("weight"))
    doc = F.to_json(
        F.struct(
            F.col("row_key").alias("model_name"), F.lit("Linear Regressor").alias("model_type"),
            F.array(one, other).alias("feature_importance"), F.lit(0.5).alias("bias"),
        )
    )
    broken = F.col("row_key").endswith("7")
    text = F.when(broken, F.substring(doc, 1, 20)).otherwise(doc)
    docs = t.weights(spark, sf_dir).select(text.alias("value"))
    return reports.importance_from_text(docs).select(
        "model_name", "bias", F.col("position").cast("bigint").alias("position"), "feature", r("weight", 8).alias("weight")
    )


_IMPORTANCE_SQL = f"""WITH {t.WEIGHTS_SQL}
    SELECT row_key AS model_name, 0.5::DOUBLE AS bias, 0::BIGINT AS position, feature, round(weight, 8) AS weight
    FROM weights WHERE row_key NOT LIKE '%7'
    UNION ALL SELECT row_key, 0.5::DOUBLE, 1, 'copy_' || feature, round(-weight, 8) FROM weights WHERE row_key NOT LIKE '%7'"""


def _log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_metrics(t.logs(spark, sf_dir)).select(
        "model", "model_type", *[r(c, 8).alias(c) for c in ("mse", "mae", "r2", "latency_ms")], "status", F.md5("error").alias("error_md5")
    )


_LOG_METRICS_SQL = """WITH logs AS (
      SELECT 'run_' || o_orderkey::VARCHAR || '.log' AS model, o_orderkey::VARCHAR AS run, o_orderkey % 13 = 0 AS failed, o_orderkey % 17 = 0 AS cut,
        list_extract(['SimpleDNN', 'LSTM', 'LinearRegressor'], (o_orderkey % 3 + 1)::INTEGER) AS mtype,
        o_totalprice / 3e6 AS mse, (o_custkey % 1000)::DOUBLE / 3e3 AS mae FROM orders)
    SELECT model, CASE WHEN failed THEN 'ERROR' ELSE mtype END AS model_type,
      CASE WHEN NOT failed AND NOT cut THEN round(mse, 8) END AS mse, CASE WHEN NOT failed AND NOT cut THEN round(mae, 8) END AS mae,
      CASE WHEN NOT failed AND NOT cut THEN round(mse - mae, 8) END AS r2,
      CASE WHEN NOT failed AND NOT cut THEN round(mae + 5e1, 8) END AS latency_ms,
      CASE WHEN failed THEN 'FAILED' WHEN cut THEN 'INCOMPLETE METRICS' ELSE 'OK' END AS status,
      CASE WHEN failed THEN md5('Traceback (most recent call last):' || chr(10) || 'ValueError: no run ' || run) END AS error_md5 FROM logs"""


def _test_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_test_loss(t.logs(spark, sf_dir)).select("file", r("test_loss", 8).alias("test_loss"))


_TEST_LOSS_SQL = """SELECT 'run_' || o_orderkey::VARCHAR || '.log' AS file,
      CASE WHEN o_orderkey % 19 = 0 THEN 5e-1 WHEN o_orderkey % 11 <> 0 THEN round(o_totalprice / 3e6, 8) END AS test_loss
    FROM orders"""


def _sink_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "windows-json")
    sinks.sink_windows_json(t.windows(spark, sf_dir), path)
    back = scan_windows(spark, path, one_per_line=True)
    return back.select(
        "file", "ts_raw", r(TARGET, 9).alias(TARGET), F.size("samples").cast("bigint").alias("n_samples"), *_sample_sums("new")
    )


_SINK_WINDOWS_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT strftime(max(ts), '%Y%m%d%H%M%S') || '.json' AS file, strftime(max(ts), '%Y%m%d%H%M%S') AS ts_raw, round(avg(qoe), 9) AS "QoE", count(*) AS n_samples,
      {', '.join(f'round(sum({m}), 4) AS sum_{m}' for m in METRICS['new'])}
    FROM samples GROUP BY window_id"""


def _sink_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "validation")
    sinks.sink_validation_pair(t.windows(spark, sf_dir), path, "20240101000000", ratio=1.0, seed=7)
    truth, masked, metadata = sinks.load_validation_pair(spark, path)
    stated = reports.scan_validation_metadata(spark, f"{path}/validation_metadata").groupBy("file").agg(F.max("format").alias("format"))
    return (
        truth.join(masked.select("window_id", F.col(TARGET).alias("masked"), F.col("samples").alias("masked_samples")), "window_id")
        .join(metadata, "file").join(stated, "file")
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("masked").alias("n_visible"), F.sum(F.size("masked_samples")).alias("n_samples"),
            F.every(F.col("samples") == F.col("masked_samples")).alias("same_samples"),
            r(F.max(TARGET), 9).alias("truth"), r(F.max("ground_truth_qoe"), 9).alias("metadata_truth"), F.max("format").alias("format"),
        )
    )


_SINK_PAIR_SQL = f"""WITH {t.WINDOWS_SQL},
    w AS (SELECT file, count(*) AS n, sum(n_samples)::BIGINT AS n_samples, round(max("QoE"), 9) AS q FROM windows GROUP BY file)
    SELECT file, n AS n_rows, 0::BIGINT AS n_visible, n_samples, TRUE AS same_samples, q AS truth, q AS metadata_truth, 'new' AS format FROM w"""


def _sink_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "validation-results")
    preds = prediction_errors(t.predictions(spark, sf_dir))
    sinks.sink_results_csv(regression_metrics(preds), preds, path)
    details = spark.read.schema("file STRING, ground_truth DOUBLE, prediction DOUBLE, error DOUBLE, model STRING").option(
        "header", True
    ).csv(f"{path}/detailed_results")
    summary = spark.read.option("header", True).csv(f"{path}/validation_summary")
    return (
        details.groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg(F.abs("error"))).alias("mae_from_details"))
        .join(summary.select("model", "model_type", r(F.col("mae").cast("double")).alias("mae")), "model")
    )


_SINK_RESULTS_SQL = f"""WITH {t.PREDICTIONS_SQL}
    SELECT model, CASE split_part(model, '_', 1) WHEN 'linear' THEN 'Linear Regressor' WHEN 'dnn' THEN 'Simple DNN'
      WHEN 'lstm' THEN 'LSTM' WHEN 'gru' THEN 'GRU' WHEN 'transformer' THEN 'Transformer' ELSE 'Unknown' END AS model_type,
      count(*) AS n_rows, round(avg(abs(error)), 6) AS mae_from_details, round(avg(abs(error)), 6) AS mae
    FROM errors GROUP BY model"""


def _sink_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended in two parts, with all their columns."""
    path = scratch_path(spark, "runs")
    runs = t.runs_text(spark, sf_dir).select(*_RUN_COLUMNS, F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("run_output"))
    sinks.append_experiments(runs.where("model_type = 'gru'"), path)
    sinks.append_experiments(runs.where("model_type <> 'gru'"), path)
    back = spark.read.schema(EXPERIMENT_SCHEMA).parquet(path)
    return back.withColumn("test_loss", try_double(F.col("test_loss")))


_SINK_EXPERIMENTS_SQL = f"""WITH {t.RUNS_SQL}
    SELECT {', '.join(_RUN_COLUMNS)}, 'run ' || run_id::VARCHAR AS run_output FROM runs"""


def _scaler_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scaler")
    sinks.save_scaler(fit_scaler(t.samples(spark, sf_dir).withColumnRenamed("qoe", TARGET), METRICS["new"]), path)
    return sinks.load_scaler(spark, path)


def _load_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored scaler applied to the rows."""
    path = scratch_path(spark, "scaler")
    rows = t.samples(spark, sf_dir).withColumnRenamed("qoe", TARGET)
    sinks.save_scaler(fit_scaler(rows, METRICS["new"]), path)
    scaled = scale(rows, sinks.load_scaler(spark, path), [*METRICS["new"], TARGET])
    return scaled.select("event_id", *[r(c, 9).alias(c) for c in (*METRICS["new"], TARGET)])


_LOAD_SCALER_SQL = f"""WITH {t.SAMPLES_SQL}, b AS (SELECT {', '.join(f'min({m}) AS lo_{m}, max({m}) AS hi_{m}' for m in (*METRICS['new'], 'qoe'))}
      FROM samples)
    SELECT event_id, {', '.join(f'round(({m} - lo_{m}) / (hi_{m} - lo_{m}), 9) AS {m}' for m in METRICS['new'])},
      round((qoe - lo_qoe) / (hi_qoe - lo_qoe), 9) AS "QoE" FROM samples, b"""


def scaler_sql() -> str:
    names = [*METRICS["new"], "qoe"]
    rows = " UNION ALL ".join(
        f"SELECT '{'QoE' if n == 'qoe' else n}' AS col, {i} AS pos, min({n}) AS min, max({n}) AS max FROM samples"
        for i, n in enumerate(names)
    )
    return f"WITH {t.SAMPLES_SQL} {rows}"


def _disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "usage")
    t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return sinks.dataset_disk_usage(spark, path, "*.txt").select("total_bytes")


_DISK_USAGE_SQL = "SELECT sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS total_bytes FROM orders"


def _repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair_types(t.documents(spark, sf_dir))
    parsed = to_windows(fixed)
    flags = fixed.select("window_id", "modified", F.col("unparsable").cast("bigint").alias("unparsable"))
    total = F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + F.coalesce(s["v"]["speed"], F.lit(0.0)))
    return parsed.select("window_id", F.coalesce(total, F.lit(0.0)).alias("sum_speed")).join(flags, "window_id")


_REPAIR_SQL = f"""WITH {t.DOCS_SQL}
    SELECT d.window_id, coalesce(sum(s.speed), 0)::DOUBLE AS sum_speed,
      d.window_id % 7 = 2 AND d.window_id % 19 <> 4 AND d.window_id % 17 <> 3 AS modified,
      CASE WHEN d.window_id % 19 = 4 THEN w.n_samples WHEN d.window_id % 17 = 3 AND d.window_id % 7 = 2 THEN w.n_samples
        ELSE 0 END AS unparsable
    FROM docs d JOIN windows w ON d.window_id = w.window_id LEFT JOIN doc_samples s ON d.window_id = s.window_id
    GROUP BY d.window_id, w.n_samples"""


def _repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_counts(repair_types(t.documents(spark, sf_dir)))


_REPAIR_COUNTS_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT count(*) AS n_processed, count_if(window_id % 7 = 2 AND window_id % 19 <> 4 AND window_id % 17 <> 3)::BIGINT AS n_modified,
      sum(CASE WHEN window_id % 19 = 4 OR (window_id % 17 = 3 AND window_id % 7 = 2) THEN n_samples ELSE 0 END)::BIGINT AS n_unparsable
    FROM windows"""


QUERIES = {
    "scan_windows": (_scan("new"), _scan_sql("new")),
    "scan_windows_legacy": (_scan("legacy"), _scan_sql("legacy")),
    "scan_windows_mean": (_scan_mean, _SCAN_MEAN_SQL),
    "scan_flat": (_scan_flat, _SCAN_FLAT_SQL),
    "scan_inference_record": (_scan_inference, _SCAN_INFERENCE_SQL),
    "scan_validation_metadata": (_metadata, _METADATA_SQL),
    "scan_results_csv": (_results_csv, _RESULTS_SQL),
    "scan_experiments_csv": (_experiments_csv, _EXPERIMENTS_SQL),
    "scan_importance": (_importance, _IMPORTANCE_SQL),
    "extract_log_metrics": (_log_metrics, _LOG_METRICS_SQL),
    "extract_test_loss": (_test_loss, _TEST_LOSS_SQL),
    "sink_windows_json": (_sink_windows, _SINK_WINDOWS_SQL),
    "sink_validation_pair": (_sink_pair, _SINK_PAIR_SQL),
    "sink_results_csv": (_sink_results, _SINK_RESULTS_SQL),
    "sink_experiments": (_sink_experiments, _SINK_EXPERIMENTS_SQL),
    "save_scaler": (_scaler_round_trip, scaler_sql()),
    "load_scaler": (_load_scaler, _LOAD_SCALER_SQL),
    "dataset_disk_usage": (_disk_usage, _DISK_USAGE_SQL),
    "repair_types": (_repair, _REPAIR_SQL),
    "repair_counts": (_repair_counts, _REPAIR_COUNTS_SQL),
}
