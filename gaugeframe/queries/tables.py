"""The engine's inputs, derived row by row from the test tables, and the same in SQL.

* sub-samples: one per event; nine consecutive events form a window of five and a ragged one
  of four. ``event_id`` is a key, so a window never holds more than five rows.
* documents: the JSON text of each window, with defects in some of them.
* predictions: one per line item; evaluation results and experiment runs: one per order;
  feature weights: one per line item; logs: one per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import qoe_formula
from gaugeframe.functions.timeparse import peak_hour, ts_digits
from gaugeframe.schemas import METRICS, STAT_METRICS, STATS, TARGET

M = METRICS["new"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_round(x: str, digits: int) -> str:
    """SQL of ``functions.numeric.exact_round`` for a column name."""
    s = f"{2 * 10**digits}e0"
    c = f"({x} * 134217729e0)"
    high = f"({c} - ({c} - {x}))"
    halves = f"round_even({x} * {s}, 0)"
    above = f"(({high} * {s} - {halves}) + ({x} - {high}) * {s})"
    odd = f"(abs({halves} % 2e0) = 1e0)"
    return (
        f"(CASE WHEN {odd} AND {above} > 0 THEN ({halves} + 1e0) / 2e0 "
        f"WHEN {odd} AND {above} < 0 THEN ({halves} - 1e0) / 2e0 "
        f"ELSE round_even({halves} / 2e0, 0) END / {10**digits}e0)"
    )


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounding for comparison, without a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


# --- sub-samples and windows ------------------------------------------------------------


def measured(events: DataFrame) -> DataFrame:
    """Sub-samples of a table or stream of events, without the target."""
    ev = events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return ev.select(
        "event_id",
        F.expr("event_id div 9 * 2 + int(event_id % 9 >= 5)").alias("window_id"),
        "ts",
        "user_id",
        "event_type",
        "k",
        F.lpad(F.col("event_id").cast("string"), 14, "0").alias("key"),
        (F.col("value") * 2.0 + 600.0).alias("throughput"),
        (F.col("k") % 6).cast("double").alias("packets_lost"),
        ((F.col("k") % 51).cast("double") / 10.0).alias("packet_loss_rate"),
        ((F.col("user_id") % 150).cast("double") / 10.0 + 15.0).alias("jitter"),
        (F.col("event_id") * 7 % 60).cast("double").alias("speed"),
        peak_hour(F.hour("ts")).alias("is_peak"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "events")).withColumn(
        "qoe",
        qoe_formula(*[F.col(c) for c in ("packet_loss_rate", "jitter", "throughput", "speed", "is_peak")]),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, file, ts, QoE, samples); at most five sub-samples each."""
    rows = samples(spark, sf_dir)
    value = F.struct(*[F.col(m) for m in M])
    grouped = rows.groupBy("window_id").agg(
        F.max("ts").alias("ts"),
        F.avg("qoe").alias(TARGET),
        F.array_sort(F.collect_list(F.struct("key", value.alias("v")))).alias("samples"),
    )
    return grouped.select("window_id", F.concat(ts_digits(F.col("ts")), F.lit(".json")).alias("file"), "ts", TARGET, "samples")


BASE_SAMPLES_SQL = f"""
ev AS (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
measured AS (
  SELECT event_id, event_id // 9 * 2 + CASE WHEN event_id % 9 >= 5 THEN 1 ELSE 0 END AS window_id, ts, user_id, event_type, k, lpad(event_id::VARCHAR, 14, '0') AS key,
    value * 2e0 + 6e2 AS throughput, (k % 6)::DOUBLE AS packets_lost, (k % 51)::DOUBLE / 1e1 AS packet_loss_rate,
    (user_id % 150)::DOUBLE / 1e1 + 15e0 AS jitter, (event_id * 7 % 60)::DOUBLE AS speed,
    (hour(ts) >= 7 AND hour(ts) < 10) OR (hour(ts) >= 17 AND hour(ts) < 20) AS is_peak
  FROM ev),
clipped AS (
  SELECT *, greatest(0e0, least(95e0 - packet_loss_rate * 4e0 - jitter * 1e-1
      + ((throughput - 6e2) / 1e3) * 5e0 - speed * 5e-2 - CASE WHEN is_peak THEN 5e0 ELSE 0e0 END, 1e2)) AS raw
  FROM measured),
samples AS (SELECT * EXCLUDE (raw), {sql_round('raw', 6)} AS qoe FROM clipped)"""

SAMPLES_SQL = BASE_SAMPLES_SQL + """,
slotted AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY key) - 1 AS slot FROM samples)"""

WINDOWS_SQL = SAMPLES_SQL + """,
windows AS (
  SELECT window_id, strftime(max(ts), '%Y%m%d%H%M%S') || '.json' AS file, max(ts) AS ts, avg(qoe) AS "QoE",
    count(*) AS n_samples
  FROM samples GROUP BY window_id)"""


def flat_sql(alias: str = "s") -> str:
    """f0..f24 of a window as conditional aggregates over ``slotted``."""
    return ", ".join(
        f"max(CASE WHEN {alias}.slot = {i} THEN {alias}.{m} END) AS f{i * len(M) + j}"
        for i in range(5)
        for j, m in enumerate(M)
    )


def stats_sql(alias: str = "s", metrics=STAT_METRICS["new"]) -> str:
    fn = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max"}
    return ", ".join(f"{fn[s]}({alias}.{m}) AS {m}_{s}" for m in metrics for s in STATS)


# --- documents --------------------------------------------------------------------------


def _entry(s: Column, window_id: Column, names: tuple[str, ...]) -> Column:
    v = s["v"]
    speed = (
        F.when(window_id % 19 == 4, F.lit('"fast"'))
        .when(window_id % 7 == 2, F.concat(F.lit('"'), v["speed"].cast("int").cast("string"), F.lit('"')))
        .otherwise(v["speed"].cast("int").cast("string"))
    )
    parts = [F.lit('"'), s["key"], F.lit('":{')]
    for m in names:
        if m == "speed":
            parts += [F.lit('"speed":'), speed, F.lit("}")]
        elif m == "packets_lost":
            text = F.concat(F.lit('"packets_lost":'), v[m].cast("string"), F.lit(","))
            parts.append(F.when(window_id % 23 == 6, F.lit("")).otherwise(text))
        else:
            parts.append(F.concat(F.lit(f'"{m}":'), v[m].cast("string"), F.lit(",")))
    return F.concat(*parts)


def documents(spark: SparkSession, sf_dir: str, layout: str = "new") -> DataFrame:
    """(window_id, file, value): JSON texts, some with defects decided by the window number."""
    names = METRICS[layout]
    wid = F.col("window_id")
    entries = F.array_join(F.transform("samples", lambda s: _entry(s, wid, names)), ",")
    digits = ts_digits(F.col("ts"))
    text = F.concat(
        F.lit('{"QoE":'),
        F.when(wid % 11 == 7, F.lit("null")).otherwise(F.col(TARGET).cast("string")),
        F.when(wid % 13 == 5, F.lit("")).when(wid % 2 == 1, F.concat(F.lit(',"timestamp":"'), digits, F.lit('"')))
        .otherwise(F.concat(F.lit(',"timestamp":'), digits)),
        F.lit(","),
        entries,
        F.when(wid % 17 == 3, F.lit("")).otherwise(F.lit("}")),
    )
    return windows(spark, sf_dir).select(
        "window_id", F.concat(F.lpad(wid.cast("string"), 8, "0"), F.lit(".json")).alias("file"), text.alias("value")
    )


# The parsed content of the documents: ``docs`` per window, ``doc_samples`` per sub-sample.
DOCS_SQL = WINDOWS_SQL + """,
docs AS (
  SELECT window_id, lpad(window_id::VARCHAR, 8, '0') || '.json' AS file, window_id % 17 = 3 AS broken,
    CASE WHEN window_id % 17 <> 3 AND window_id % 13 <> 5 THEN strftime(ts, '%Y%m%d%H%M%S') END AS ts_raw,
    CASE WHEN window_id % 17 <> 3 AND window_id % 11 <> 7 THEN "QoE" END AS "QoE"
  FROM windows),
doc_samples AS (
  SELECT window_id, slot, key, throughput, CASE WHEN window_id % 23 <> 6 THEN packets_lost END AS packets_lost,
    packet_loss_rate, jitter, CASE WHEN window_id % 19 <> 4 THEN speed END AS speed
  FROM slotted WHERE window_id % 17 <> 3)"""


def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): one flat JSON record per event, every ninth to be scored, some damaged."""
    rows = samples(spark, sf_dir)
    eid = F.col("event_id")
    number = lambda m: F.concat(F.lit(f'"{m}":'), F.col(m).cast("string"), F.lit(","))
    text = F.concat(
        F.lit("{"),
        number("packet_loss_rate"),
        F.when(eid % 29 == 3, F.lit('"jitter":"n/a",')).otherwise(number("jitter")),
        number("throughput"),
        F.lit('"speed":"'), F.col("speed").cast("int").cast("string"), F.lit('",'),
        F.lit('"QoE":'), F.when(eid % 9 == 0, F.lit("null")).otherwise(F.col("qoe").cast("string")),
        F.lit(',"timestamp":"'), F.when(eid % 31 == 5, F.lit("20240101000099")).otherwise(ts_digits(F.col("ts"))),
        F.lit('"}'),
    )
    return rows.select("event_id", text.alias("value"))


FLAT_SQL = BASE_SAMPLES_SQL + """,
flat AS (
  SELECT event_id, packet_loss_rate, CASE WHEN event_id % 29 <> 3 THEN jitter END AS jitter, throughput, speed,
    CASE WHEN event_id % 9 <> 0 THEN qoe END AS "QoE", CASE WHEN event_id % 31 <> 5 THEN date_trunc('second', ts) END AS ts
  FROM samples)"""


# --- predictions ------------------------------------------------------------------------

TYPE_WORDS = ("linear", "dnn", "lstm", "gru", "transformer", "svr")


def word_case(number: Column, words=TYPE_WORDS) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (number % len(words) + 1).cast("int"))


def sql_words(number: str, words=TYPE_WORDS) -> str:
    return "list_extract([" + ", ".join(f"'{w}'" for w in words) + f"], ({number} % {len(words)} + 1)::INTEGER)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, file, ground_truth, prediction): twelve models over all line items."""
    truth = F.col("l_extendedprice") / 1100.0
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            word_case(F.col("l_suppkey")), F.lit("_"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".h5")
        ).alias("model"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("file"),
        truth.alias("ground_truth"),
        (truth * 0.9 + (F.col("l_quantity") - 25.0) / 5.0 + F.col("l_discount") * 40.0).alias("prediction"),
    )


PREDICTIONS_SQL = f"""
predictions AS (
  SELECT {sql_words('l_suppkey')} || '_' || (l_suppkey % 4)::VARCHAR || '.h5' AS model,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS file,
    l_extendedprice / 11e2 AS ground_truth,
    (l_extendedprice / 11e2) * 9e-1 + (l_quantity - 25e0) / 5e0 + l_discount * 4e1 AS prediction
  FROM lineitem),
errors AS (SELECT *, prediction - ground_truth AS error FROM predictions)"""

METRICS_SQL = PREDICTIONS_SQL + """,
metrics AS (
  SELECT model, avg(error * error) AS mse, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae,
    median(abs(error)) AS medae,
    1 - sum(error * error) / (count(*) * var_pop(ground_truth)) AS r2,
    1 - var_pop(error) / var_pop(ground_truth) AS explained_variance,
    avg(error) AS mean_error, max(abs(error)) AS max_error, min(abs(error)) AS min_error
  FROM errors GROUP BY model)"""


# --- evaluation results, runs, weights, logs ------------------------------------------------


def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation row per order as it stands in the CSV: texts, ``null`` for failures."""
    failed = F.col("o_orderkey") % 37 == 0
    text = lambda value: F.when(failed, F.lit("null")).otherwise(value.cast("string"))
    word = word_case(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        F.concat(word, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".h5")).alias("Model"),
        F.when(failed, F.lit("ERROR")).otherwise(word).alias("Model Type"),
        text(F.col("o_totalprice") / 3000000.0).alias("MSE"),
        text((F.col("o_custkey") % 1000).cast("double") / 3000.0 + 0.1).alias("MAE"),
        text(0.2 - (F.col("o_orderkey") % 997).cast("double") / 1000.0).alias("R2"),
        text(F.col("o_totalprice") / 25000.0 + 50.0).alias("Inference Latency (ms)"),
    )


RESULTS_SQL = f"""
results AS (
  SELECT {sql_words('o_custkey')} || '_' || o_orderkey::VARCHAR || '.h5' AS model,
    CASE WHEN o_orderkey % 37 = 0 THEN 'ERROR' ELSE {sql_words('o_custkey')} END AS model_type,
    CASE WHEN o_orderkey % 37 <> 0 THEN o_totalprice / 3e6 END AS mse,
    CASE WHEN o_orderkey % 37 <> 0 THEN (o_custkey % 1000)::DOUBLE / 3e3 + 1e-1 END AS mae,
    CASE WHEN o_orderkey % 37 <> 0 THEN 2e-1 - (o_orderkey % 997)::DOUBLE / 1e3 END AS r2,
    CASE WHEN o_orderkey % 37 <> 0 THEN o_totalprice / 25e3 + 5e1 END AS latency_ms
  FROM orders)"""

RUN_TYPES = ("lstm", "gru", "transformer")


def runs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment run per order; the loss is text and sometimes missing."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    loss = F.when(key % 41 == 0, F.lit("failed")).when(key % 43 == 0, F.lit("")).otherwise(
        (F.round(F.col("o_totalprice") / 100.0, 0) / 100000.0).cast("string")
    )
    recurrent = cust % 3 != 2
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        word_case(cust, RUN_TYPES).alias("model_type"),
        (key % 2 * 5 + 5).cast("int").alias("seq_length"),
        F.when(recurrent, (key.bitwiseAND(2) * 25 + 50).cast("int")).alias("hidden_units"),
        F.when(recurrent, (F.floor(key / 4) % 2 + 1).cast("int")).alias("num_layers"),
        F.when(F.floor(key / 8) % 2 == 0, F.lit(0.2)).otherwise(F.lit(0.3)).alias("dropout_rate"),
        F.when(F.floor(key / 16) % 2 == 0, F.lit(0.001)).otherwise(F.lit(0.0005)).alias("learning_rate"),
        F.when(recurrent, F.floor(key / 32) % 2 == 1).alias("bidirectional"),
        F.when(~recurrent, (F.floor(key / 2) % 2 * 2 + 2).cast("int")).alias("num_heads"),
        F.when(~recurrent, (F.floor(key / 4) % 2 * 64 + 64).cast("int")).alias("ff_dim"),
        loss.alias("test_loss"),
    )


RUNS_SQL = f"""
runs AS (
  SELECT o_orderkey AS run_id, {sql_words('o_custkey', RUN_TYPES)} AS model_type,
    (o_orderkey % 2 * 5 + 5)::INTEGER AS seq_length,
    CASE WHEN o_custkey % 3 <> 2 THEN ((o_orderkey & 2) * 25 + 50)::INTEGER END AS hidden_units,
    CASE WHEN o_custkey % 3 <> 2 THEN (o_orderkey // 4 % 2 + 1)::INTEGER END AS num_layers,
    CASE WHEN o_orderkey // 8 % 2 = 0 THEN 2e-1 ELSE 3e-1 END AS dropout_rate,
    CASE WHEN o_orderkey // 16 % 2 = 0 THEN 1e-3 ELSE 5e-4 END AS learning_rate,
    CASE WHEN o_custkey % 3 <> 2 THEN o_orderkey // 32 % 2 = 1 END AS bidirectional,
    CASE WHEN o_custkey % 3 = 2 THEN (o_orderkey // 2 % 2 * 2 + 2)::INTEGER END AS num_heads,
    CASE WHEN o_custkey % 3 = 2 THEN (o_orderkey // 4 % 2 * 64 + 64)::INTEGER END AS ff_dim,
    CASE WHEN o_orderkey % 41 <> 0 AND o_orderkey % 43 <> 0 THEN round(o_totalprice / 1e2) / 1e5 END AS test_loss
  FROM orders)"""

STAT_FEATURES = [f"{m}_{s}" for m in STAT_METRICS["new"] for s in STATS]


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_name, feature, weight): one per line item, some names without a lag."""
    number = F.col("l_partkey") % 45
    name = F.when(number < 25, F.concat(F.lit("f"), number.cast("string"))).otherwise(
        F.element_at(F.array(*[F.lit(n) for n in STAT_FEATURES]), F.greatest(number - 24, F.lit(1)).cast("int"))
    )
    lag = F.concat(F.lit("_t-"), (F.col("l_linenumber") % 5 + 1).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("linear_"), (F.col("l_suppkey") % 8).cast("string"), F.lit(".h5")).alias("model_name"),
        F.when(F.col("l_linenumber") == 7, name).otherwise(F.concat(name, lag)).alias("feature"),
        ((F.col("l_discount") - F.col("l_tax")) * F.col("l_quantity") + F.col("l_extendedprice") / 1000000.0).alias("weight"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
    )


WEIGHTS_SQL = f"""
named AS (
  SELECT *, CASE WHEN l_partkey % 45 < 25 THEN 'f' || (l_partkey % 45)::VARCHAR
    ELSE list_extract([{', '.join(f"'{n}'" for n in STAT_FEATURES)}], greatest(l_partkey % 45 - 24, 1)::INTEGER) END AS fname
  FROM lineitem),
weights AS (
  SELECT 'linear_' || (l_suppkey % 8)::VARCHAR || '.h5' AS model_name,
    CASE WHEN l_linenumber = 7 THEN fname ELSE fname || '_t-' || (l_linenumber % 5 + 1)::VARCHAR END AS feature,
    (l_discount - l_tax) * l_quantity + l_extendedprice / 1e6 AS weight,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key
  FROM named)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lines): the output of one evaluation per order, some failed or cut short.

    Fixed values: the phrases of the log format.
    """
    key = F.col("o_orderkey")
    number = lambda c: c.cast("string")
    mse, mae = F.col("o_totalprice") / 3000000.0, (F.col("o_custkey") % 1000).cast("double") / 3000.0
    lines = F.array(
        F.lit("Loading model"),
        F.concat(F.lit("Detected model type: "), F.element_at(F.array(F.lit("Simple DNN"), F.lit("LSTM"), F.lit("Linear Regressor")), (key % 3 + 1).cast("int"))),
        F.when(key % 13 == 0, F.lit("Traceback (most recent call last):")).otherwise(F.lit("Evaluating model...")),
        F.when(key % 13 == 0, F.concat(F.lit("ValueError: no run "), key.cast("string"))).otherwise(F.lit("")),
        F.concat(F.lit("Test Loss: "), F.when(key % 11 == 0, F.lit("nan?")).otherwise(number(mse))),
        F.concat(F.lit("Mean Squared Error (MSE): "), number(mse)),
        F.concat(F.lit("Mean Absolute Error (MAE): "), number(mae)),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("R^2 Score: "), number(mse - mae))),
        F.lit("Metrics in Original Scale:"),
        F.concat(F.lit("Mean Squared Error (MSE): "), number(mse * 10000.0)),
        F.concat(F.lit("Average Inference Latency on Current System: "), number(mae + 50.0), F.lit(" ms")),
        F.when(key % 19 == 0, F.lit("Test Loss: 0.5")).otherwise(F.lit("done")),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), key.cast("string"), F.lit(".log")).alias("file"), lines.alias("lines")
    )
