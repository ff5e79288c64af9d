"""Typing, cleaning, features, scaling, profiles and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import numeric, text, timeparse
from gaugeframe.operators import clean, features, generate, profile, scaling
from gaugeframe.operators.importance import parse_feature_names
from gaugeframe.queries import tables as t
from gaugeframe.queries.scans import scaler_sql
from gaugeframe.queries.tables import r
from gaugeframe.schemas import FLAT_METRICS, METRICS, STAT_METRICS, STATS, TARGET, feature_names
from gaugeframe.sources.windows import doc_value, drop_meta_keys, flat_from_text, with_document

M = METRICS["new"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_document(t.documents(spark, sf_dir))


def _flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flatten_samples(t.windows(spark, sf_dir)).select("window_id", *feature_names())


_FLATTEN_SQL = f"WITH {t.SAMPLES_SQL} SELECT s.window_id, {t.flat_sql()} FROM slotted s GROUP BY s.window_id"


def _drop_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_meta_keys(F.col("doc"))
    return _docs(spark, sf_dir).select(
        "window_id", F.coalesce(F.size(F.map_keys(kept)), F.lit(0)).cast("bigint").alias("n_keys"),
        F.array_join(F.map_keys(kept), "|").alias("keys"),
    )


_DROP_META_SQL = f"""WITH {t.DOCS_SQL}
    SELECT d.window_id, count(s.key) AS n_keys, string_agg(s.key, '|' ORDER BY s.key) AS keys
    FROM docs d LEFT JOIN doc_samples s ON d.window_id = s.window_id GROUP BY d.window_id"""


def _coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = flat_from_text(t.flat_records(spark, sf_dir)).select(F.col("event_id").alias("file"), *FLAT_METRICS, TARGET)
    return clean.coerce_numeric(raw).withColumnRenamed("file", "event_id")


_COERCE_SQL = f'WITH {t.FLAT_SQL} SELECT event_id, packet_loss_rate, jitter, throughput, speed, "QoE" FROM flat'


def _parse_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("window_id", doc_value(F.col("doc"), "timestamp").alias("timestamp"))
    flat = flat_from_text(t.flat_records(spark, sf_dir)).select("event_id", "timestamp")
    both = docs.select(F.lit("window").alias("kind"), F.col("window_id").alias("id"), "timestamp").unionByName(
        flat.select(F.lit("record").alias("kind"), F.col("event_id").alias("id"), "timestamp")
    )
    return clean.with_parsed_ts(both).select("kind", "id", F.unix_seconds("ts").alias("epoch"))


_PARSE_TS_SQL = f"""WITH {t.DOCS_SQL},
    flat_ts AS (SELECT event_id, CASE WHEN event_id % 31 <> 5 THEN ts END AS ts FROM samples)
    SELECT 'window' AS kind, window_id AS id, epoch(try_strptime(ts_raw, '%Y%m%d%H%M%S'))::BIGINT AS epoch FROM docs
    UNION ALL SELECT 'record', event_id, epoch(date_trunc('second', ts))::BIGINT FROM flat_ts"""


def _normalize_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.windows(spark, sf_dir).select("window_id", timeparse.normalize_ts_digits(rendered).alias("digits"))


_NORMALIZE_TS_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT window_id, regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '[^0-9]', '', 'g') AS digits FROM windows"""


def _ts_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    wid = F.col("window_id")
    names = F.when(wid % 5 == 0, F.concat(F.lit("part_"), F.col("file"))).otherwise(F.col("file"))
    return t.windows(spark, sf_dir).select("window_id", timeparse.ts_from_filename(names).alias("file_ts"))


_TS_FROM_FILENAME_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT window_id, CASE WHEN window_id % 5 = 0 THEN 0 ELSE split_part(file, '.', 1)::BIGINT END AS file_ts FROM windows"""


def _select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features.flatten_samples(t.windows(spark, sf_dir))
    kept = features.select_features(frame, drop=("window_id",))
    return kept.agg(*[r(F.avg(c)).alias(f"avg_{c}") for c in kept.columns])


_SELECT_FEATURES_SQL = f"""WITH {t.WINDOWS_SQL},
    flat AS (SELECT s.window_id, {t.flat_sql()} FROM slotted s GROUP BY s.window_id)
    SELECT {', '.join(f'round(avg(f{i}), 6) AS avg_f{i}' for i in range(25))}, round(avg("QoE"), 6) AS "avg_QoE"
    FROM windows w JOIN flat f ON w.window_id = f.window_id"""


def _temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.temporal_fields(t.table(spark, sf_dir, "events").select("event_id", "ts"))
    return rows.select("event_id", *[F.col(c).cast("bigint").alias(c) for c in ("hour", "minute", "day_of_week")])


_TEMPORAL_SQL = """SELECT event_id, hour(ts)::BIGINT AS hour, minute(ts)::BIGINT AS minute,
    (isodow(ts) - 1)::BIGINT AS day_of_week FROM events"""


def _peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = features.peak_hour_flag(t.table(spark, sf_dir, "events").select("event_id", "ts"))
    return flagged.groupBy("is_peak").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("sum_id"))


_PEAK_SQL = """SELECT (hour(ts) >= 7 AND hour(ts) < 10) OR (hour(ts) >= 17 AND hour(ts) < 20) AS is_peak, count(*) AS n,
    sum(event_id)::BIGINT AS sum_id FROM events GROUP BY 1"""


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.valid_window(_docs(spark, sf_dir)).select("window_id", "file")


_IS_VALID = "window_id % 17 <> 3 AND window_id % 13 <> 5 AND window_id % 11 <> 7 AND window_id % 23 <> 6"
_VALID_SQL = f"WITH {t.DOCS_SQL} SELECT window_id, file FROM docs WHERE {_IS_VALID}"


def _validity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.validity_counts(_docs(spark, sf_dir))


_VALIDITY_SQL = f"""WITH {t.DOCS_SQL}
    SELECT count_if({_IS_VALID})::BIGINT AS n_valid, count_if(NOT ({_IS_VALID}))::BIGINT AS n_invalid FROM docs"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = clean.mask_target(t.windows(spark, sf_dir))
    return masked.select("window_id", TARGET, r("QoE_truth", 9).alias("QoE_truth"))


_MASK_SQL = f'WITH {t.WINDOWS_SQL} SELECT window_id, NULL::DOUBLE AS "QoE", round("QoE", 9) AS "QoE_truth" FROM windows'


def _null_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.results_text(spark, sf_dir).toDF("model", "model_type", "mse", "mae", "r2", "latency_ms")
    return clean.null_literal_clean(raw, ("mse", "mae", "r2", "latency_ms"))


_NULL_LITERAL_SQL = f"WITH {t.RESULTS_SQL} SELECT * FROM results WHERE mse IS NOT NULL"


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.results_text(spark, sf_dir).select(F.concat(F.lit("Models/GRU/"), F.initcap("Model")).alias("path"))
    return names.groupBy(text.classify_model(F.col("path")).alias("model_type")).agg(F.count(F.lit(1)).alias("n"))


_CLASSIFY_SQL = f"""WITH {t.RESULTS_SQL}
    SELECT CASE split_part(model, '_', 1) WHEN 'linear' THEN 'Linear Regressor' WHEN 'dnn' THEN 'Simple DNN'
      WHEN 'lstm' THEN 'LSTM' WHEN 'gru' THEN 'GRU' WHEN 'transformer' THEN 'Transformer' ELSE 'Unknown' END AS model_type,
      count(*) AS n FROM results GROUP BY 1"""


def _parse_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t.weights(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return parse_feature_names(names).withColumn("step", F.col("step").cast("bigint"))


_STAT_OF = """CASE WHEN contains(feature, '_mean') THEN '_mean' WHEN contains(feature, '_std') THEN '_std'
      WHEN contains(feature, '_min') THEN '_min' WHEN contains(feature, '_max') THEN '_max' END"""
FEATURE_PARTS_SQL = f"""CASE WHEN contains(feature, '_t-') THEN regexp_extract(feature, '^(.*?)_t-', 1)
      ELSE regexp_replace(feature, '(_mean|_std|_min|_max)$', '') END AS base_feature,
    CASE WHEN contains(feature, '_t-') THEN regexp_extract(feature, '_t-([0-9]+)', 1)::BIGINT END AS step, {_STAT_OF} AS stat"""
_PARSE_FEATURE_SQL = f"WITH {t.WEIGHTS_SQL} SELECT feature, count(*) AS n, {FEATURE_PARTS_SQL} FROM weights GROUP BY feature"


def _clip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = (F.col("l_extendedprice") - 10000.0) / 733.0
    return t.table(spark, sf_dir, "lineitem").groupBy(numeric.clip_round(price).alias("clipped")).agg(
        F.count(F.lit(1)).alias("n")
    )


_CLIP_ROUND_SQL = f"""WITH x AS (SELECT greatest(0e0, least((l_extendedprice - 1e4) / 733e0, 1e2)) AS v FROM lineitem)
    SELECT {t.sql_round('v', 6)} AS clipped, count(*) AS n FROM x GROUP BY 1"""


def _round2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem").withColumn(
        "v", (F.col("l_extendedprice") + F.col("l_quantity") + F.col("l_tax") + F.col("l_discount")) / 4.0
    )
    return rows.groupBy("l_suppkey").agg(r(F.sum(numeric.exact_round(F.col("v"), 2)), 4).alias("sum_rounded"))


_ROUND2_SQL = f"""WITH x AS (SELECT l_suppkey, (l_extendedprice + l_quantity + l_tax + l_discount) / 4e0 AS v FROM lineitem)
    SELECT l_suppkey, round(sum({t.sql_round('v', 2)}), 4) AS sum_rounded FROM x GROUP BY l_suppkey"""


def _cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.stddev_pop("l_extendedprice").alias("sd"), F.avg("l_extendedprice").alias("mean")
    )
    return rows.select("l_partkey", r(numeric.coefficient_of_variation(F.col("sd"), F.col("mean"))).alias("cv"))


_CV_SQL = """SELECT l_partkey, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv
    FROM lineitem GROUP BY l_partkey"""

_STAT_NAMES = [f"{m}_{s}" for m in STAT_METRICS["new"] for s in STATS]


def _window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_stats(t.windows(spark, sf_dir)).select("window_id", *[r(c).alias(c) for c in _STAT_NAMES])


def _window_stats_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_stats_tall(t.samples(spark, sf_dir), ["window_id"]).select(
        "window_id", *[r(c).alias(c) for c in _STAT_NAMES]
    )


_WINDOW_STATS_SQL = f"""WITH {t.SAMPLES_SQL}, x AS (SELECT s.window_id, {t.stats_sql()} FROM samples s GROUP BY s.window_id)
    SELECT window_id, {', '.join(f'round({c}, 6) AS {c}' for c in _STAT_NAMES)} FROM x"""


def _window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_means(t.windows(spark, sf_dir)).select("window_id", *FLAT_METRICS)


_WINDOW_MEANS_SQL = f"""WITH {t.SAMPLES_SQL}, means AS (SELECT window_id,
      {', '.join(f'list_sum(list({m} ORDER BY key)) / count({m}) AS raw_{m}' for m in FLAT_METRICS)} FROM samples GROUP BY window_id)
    SELECT window_id, {', '.join(f"{t.sql_round(f'raw_{m}', 2)} AS {m}" for m in FLAT_METRICS)} FROM means"""


def _window_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_target(t.samples(spark, sf_dir), ["window_id"]).select("window_id", r(TARGET, 9).alias(TARGET))


_WINDOW_TARGET_SQL = f'WITH {t.SAMPLES_SQL} SELECT window_id, round(avg(qoe), 9) AS "QoE" FROM samples GROUP BY window_id'


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = profile.dataset_profile(profile.profile_values(t.samples(spark, sf_dir), t.windows(spark, sf_dir)))
    return table.select("metric", *[r(c).alias(c) for c in table.columns if c != "metric"])


_PROFILE_SQL = f"""WITH {t.WINDOWS_SQL},
    v AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {m} AS value FROM samples" for m in M)}
      UNION ALL SELECT 'QoE', "QoE" FROM windows)
    SELECT metric, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
      round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25,
      round(quantile_cont(value, 0.75), 6) AS p75, round(stddev_pop(value) / avg(value), 6) AS cv FROM v GROUP BY metric"""


def _span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = profile.dataset_span(t.windows(spark, sf_dir))
    return span.select(
        "n_files", timeparse.ts_digits(F.col("start_ts")).alias("start_ts"), timeparse.ts_digits(F.col("end_ts")).alias("end_ts"),
        "span_seconds", r("estimated_hours").alias("estimated_hours"),
    )


_SPAN_SQL = f"""WITH {t.WINDOWS_SQL}
    SELECT count(*) AS n_files, strftime(min(ts), '%Y%m%d%H%M%S') AS start_ts, strftime(max(ts), '%Y%m%d%H%M%S') AS end_ts,
      (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS span_seconds, round((count(*) - 1) * 1e1 / 36e2, 6) AS estimated_hours
    FROM windows"""


def _fit_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.fit_scaler(t.samples(spark, sf_dir).withColumnRenamed("qoe", TARGET), M)


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = t.samples(spark, sf_dir).withColumn("flat_line", F.lit(3.5)).withColumnRenamed("qoe", TARGET)
    return rows, scaling.fit_scaler(rows, [*M, "flat_line"])


def _scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*M, "flat_line", TARGET]
    rows, scaler = _scaled(spark, sf_dir)
    return scaling.scale(rows, scaler, names).select("event_id", *[r(c, 9).alias(c) for c in names])


def _scale_expr(c: str) -> str:
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"


_SCALE_SQL = f"""WITH {t.SAMPLES_SQL}
    SELECT event_id, {', '.join(f'round({_scale_expr(m)}, 9) AS {m}' for m in M)}, 0e0 AS flat_line,
      round({_scale_expr('qoe')}, 9) AS "QoE" FROM samples"""


def _apply_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*M, TARGET]
    rows, scaler = _scaled(spark, sf_dir)
    scaled = scaling.scale(rows, scaler, names)
    return scaled.groupBy("user_id").agg(*[r(F.avg(c), 9).alias(f"avg_{c}") for c in names])


_APPLY_SCALER_SQL = f"""WITH {t.SAMPLES_SQL}, b AS (
      SELECT {', '.join(f'min({m}) AS lo_{m}, max({m}) AS hi_{m}' for m in (*M, 'qoe'))} FROM samples)
    SELECT user_id, {', '.join(f'round(avg(({m} - lo_{m}) / (hi_{m} - lo_{m})), 9) AS avg_{m}' for m in M)},
      round(avg((qoe - lo_qoe) / (hi_qoe - lo_qoe)), 9) AS "avg_QoE" FROM samples, b GROUP BY user_id"""


def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scaler = _scaled(spark, sf_dir)
    predicted = rows.select("event_id", ((F.col("event_id") % 101).cast("double") / 100.0).alias("prediction"))
    return scaling.inverse_scale(predicted, scaler, ["prediction"]).select("event_id", r("prediction", 8).alias("prediction"))


_INVERSE_SQL = f"""WITH {t.SAMPLES_SQL}, b AS (SELECT min(qoe) AS lo, max(qoe) AS hi FROM samples)
    SELECT event_id, round((event_id % 101)::DOUBLE / 1e2 * (hi - lo) + lo, 8) AS prediction FROM samples, b"""


def _scale_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = t.samples(spark, sf_dir).where("event_type <> 'signup'").withColumnRenamed("qoe", TARGET)
    new = t.samples(spark, sf_dir).where("event_type = 'signup'").drop("qoe")
    scaler = scaling.fit_scaler(known, FLAT_METRICS)
    return scaling.scale(new, scaler, FLAT_METRICS).select("event_id", *[r(c, 9).alias(c) for c in FLAT_METRICS])


_SCALE_NEW_SQL = f"""WITH {t.SAMPLES_SQL}, b AS (
      SELECT {', '.join(f'min({m}) AS lo_{m}, max({m}) AS hi_{m}' for m in FLAT_METRICS)} FROM samples WHERE event_type <> 'signup')
    SELECT event_id, {', '.join(f'round(({m} - lo_{m}) / (hi_{m} - lo_{m}), 9) AS {m}' for m in FLAT_METRICS)}
    FROM samples, b WHERE event_type = 'signup'"""


def _qoe_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.samples(spark, sf_dir).select("event_id", "qoe")


_QOE_SQL = f"WITH {t.BASE_SAMPLES_SQL} SELECT event_id, qoe FROM samples"


def _generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return generate.generate_measurements(rows, "event_id", seed=7).select("event_id", *M, "qoe")


def _generator_sql(source: str, keep: str) -> str:
    """The generator over a relation with ``gkey`` and ``gts``."""
    draws = {"loss": (0, 0), "lost": (0, 1), "jit": (0, 2), "thr": (0, 3), "spd": (1, 0), "extra": (1, 1), "noise": (1, 2)}
    u = ", ".join(f"('0x' || substr(d{b}, {1 + 8 * i}, 8))::BIGINT::DOUBLE / 4294967296e0 AS u_{n}" for n, (b, i) in draws.items())
    return f"""
    g0 AS (SELECT *, md5(gkey::VARCHAR || ':7:0') AS d0, md5(gkey::VARCHAR || ':7:1') AS d1,
      (hour(gts) >= 7 AND hour(gts) < 10) OR (hour(gts) >= 17 AND hour(gts) < 20) AS peak FROM {source}),
    g1 AS (SELECT {keep}, peak, {u} FROM g0),
    g2 AS (SELECT {keep}, peak, u_loss * 5e0 AS a, u_lost * 5e0 AS b, u_jit * 15e0 + 15e0 AS c, u_thr * 1e3 + 6e2 AS d,
      u_spd * 6e1 AS e, u_extra * 5e0 AS x, u_noise * 2e0 - 1e0 AS z FROM g1),
    g3 AS (SELECT {keep}, peak, z, {t.sql_round('d', 1)} AS throughput, {t.sql_round('b', 1)} AS packets_lost,
      {t.sql_round('a', 2)} AS packet_loss_rate, {t.sql_round('c', 3)} + CASE WHEN peak THEN x ELSE 0e0 END AS jitter,
      {t.sql_round('e', 0)} AS speed FROM g2),
    g4 AS (SELECT *, greatest(0e0, least(95e0 - packet_loss_rate * 4e0 - jitter * 1e-1 + ((throughput - 6e2) / 1e3) * 5e0
      - speed * 5e-2 - CASE WHEN peak THEN 5e0 ELSE 0e0 END + z, 1e2)) AS raw FROM g3),
    generated AS (SELECT * EXCLUDE (raw), {t.sql_round('raw', 6)} AS qoe FROM g4)"""


_GENERATE_SQL = f"""WITH src AS (SELECT event_id, event_id AS gkey, ts AS gts FROM events), {_generator_sql('src', 'event_id')}
    SELECT event_id, throughput, packets_lost, packet_loss_rate, jitter, speed, qoe FROM generated"""


def _generate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("window_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("start_ts")
    )
    made = generate.generate_windows(starts, seed=7)
    total = lambda m: r(F.aggregate("samples", F.lit(0.0), lambda acc, s: acc + s["v"][m]), 6)
    return made.select(
        "window_id", "file", r(TARGET, 9).alias(TARGET), F.get("samples", F.lit(4))["key"].alias("last_key"),
        *[total(m).alias(f"sum_{m}") for m in M],
    )


_GENERATE_WINDOWS_SQL = f"""WITH src AS (
      SELECT event_id AS window_id, j, event_id * 5 + j AS gkey, date_trunc('second', ts) + to_seconds(2 * j) AS gts,
        date_trunc('second', ts) + to_seconds(8) AS wts FROM events, range(5) x(j)), {_generator_sql('src', 'window_id, wts')}
    SELECT window_id, strftime(max(wts), '%Y%m%d%H%M%S') || '.json' AS file, round(avg(qoe), 9) AS "QoE",
      strftime(max(wts), '%Y%m%d%H%M%S') AS last_key, {', '.join(f'round(sum({m}), 6) AS sum_{m}' for m in M)}
    FROM generated GROUP BY window_id"""


QUERIES = {
    "flatten_samples": (_flatten, _FLATTEN_SQL),
    "drop_meta_keys": (_drop_meta, _DROP_META_SQL),
    "coerce_numeric": (_coerce, _COERCE_SQL),
    "parse_ts": (_parse_ts, _PARSE_TS_SQL),
    "normalize_ts_digits": (_normalize_ts, _NORMALIZE_TS_SQL),
    "ts_from_filename": (_ts_from_filename, _TS_FROM_FILENAME_SQL),
    "select_features": (_select_features, _SELECT_FEATURES_SQL),
    "temporal_fields": (_temporal, _TEMPORAL_SQL),
    "peak_hour_flag": (_peak, _PEAK_SQL),
    "valid_window": (_valid, _VALID_SQL),
    "validity_counts": (_validity_counts, _VALIDITY_SQL),
    "mask_target": (_mask, _MASK_SQL),
    "null_literal_clean": (_null_literal, _NULL_LITERAL_SQL),
    "classify_model": (_classify, _CLASSIFY_SQL),
    "parse_feature_name": (_parse_feature, _PARSE_FEATURE_SQL),
    "clip_round": (_clip_round, _CLIP_ROUND_SQL),
    "round2_mean": (_round2, _ROUND2_SQL),
    "coefficient_of_variation": (_cv, _CV_SQL),
    "window_stats": (_window_stats, _WINDOW_STATS_SQL),
    "window_stats_tall": (_window_stats_tall, _WINDOW_STATS_SQL),
    "window_means": (_window_means, _WINDOW_MEANS_SQL),
    "window_target": (_window_target, _WINDOW_TARGET_SQL),
    "dataset_profile": (_profile, _PROFILE_SQL),
    "dataset_span": (_span, _SPAN_SQL),
    "fit_scaler": (_fit_scaler, scaler_sql()),
    "scale": (_scale, _SCALE_SQL),
    "apply_scaler": (_apply_scaler, _APPLY_SCALER_SQL),
    "inverse_scale": (_inverse, _INVERSE_SQL),
    "scale_new_record": (_scale_new, _SCALE_NEW_SQL),
    "qoe_formula": (_qoe_formula, _QOE_SQL),
    "generate_measurements": (_generate, _GENERATE_SQL),
    "generate_windows": (_generate_windows, _GENERATE_WINDOWS_SQL),
}
