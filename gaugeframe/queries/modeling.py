"""Models, search, scoring, flows and streams.

The linear fits use all metrics at ``STEPS`` steps. SQL states the same fits from the covariances of
the training rows, by coordinate descent that goes on until nothing moves in the compared digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.models import score, search
from gaugeframe.models.frames import predict, to_frame
from gaugeframe.models.linear import fit_linear, fitted, linear_importance
from gaugeframe.models.moments import moments
from gaugeframe.models.nonlinear import fit_nonlinear
from gaugeframe.operators import lookups, sequences, splits
from gaugeframe.operators.sequences import feature_step_names
from gaugeframe.plans import flows
from gaugeframe.plans.ordered import dense_index, row_total
from gaugeframe.queries import tables as t
from gaugeframe.queries.ordering import ORDERED_SQL
from gaugeframe.queries.tables import r
from gaugeframe.schemas import METRICS, STATS, TARGET
from gaugeframe.session import materialize, scratch_path
from gaugeframe.sources import sinks
from gaugeframe.streaming import score as stream_scoring
from gaugeframe.streaming import windows as stream_windowing

M = METRICS["new"]
STEPS = 5
WIDTH = STEPS * len(M)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.samples(spark, sf_dir).select("event_id", "user_id", "ts", *M, F.col("qoe").alias(TARGET))
    return dense_index(rows, ["ts", "event_id"])


def _sequences(spark: SparkSession, sf_dir: str, length: int = STEPS) -> DataFrame:
    """All sequences in time order, with the label of their part of the split."""
    indexed = _indexed(spark, sf_dir)
    made = to_frame(sequences.make_sequences(indexed, length, M, carry=["event_id"]))
    cut = splits.split_point(F.greatest(row_total(indexed) - length, F.lit(0)), 0.8)
    return made.withColumn("part", F.when(F.col("seq") < cut, "train").otherwise("test"))


def _frames(spark: SparkSession, sf_dir: str, length: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """Training and test sequences, stored once for all fits."""
    made = materialize(_sequences(spark, sf_dir, length), "sequences")
    return tuple(made.where(F.col("part") == part).drop("part") for part in ("train", "test"))


def _variants(train: DataFrame, names=tuple(search.LINEAR_VARIANTS)) -> dict:
    """Named linear models, all solved from one pass over the rows."""
    sums = moments(train, WIDTH)["all"]
    return {name: fitted(sums, *search.LINEAR_VARIANTS[name]) for name in names}


def _x_sql(prefix: str = "", last: int = 1) -> str:
    """The flattened sequence that ends ``last`` rows before a row, as a list."""
    return "[" + ", ".join(f"lag({prefix}{m}, {k}) OVER w" for k in range(STEPS - 1 + last, last - 1, -1) for m in M) + "]"


_PARTS_SQL = f"""
    n AS (SELECT count(*) - {STEPS} AS n FROM ordered),
    train AS (SELECT xy.* FROM xy, n WHERE seq >= 0 AND seq < floor(n * 8e-1)),
    test AS (SELECT xy.* FROM xy, n WHERE seq >= 0 AND seq >= floor(n * 8e-1))"""
_XY_SQL = ORDERED_SQL + f""",
    xy AS (SELECT event_id, idx - {STEPS} AS seq, {_x_sql()} AS x, qoe AS y FROM ordered WINDOW w AS (ORDER BY idx)),{_PARTS_SQL}"""


def _fits_sql(settings: dict[str, tuple[float, float]], width: int = WIDTH, sweeps: int = 60) -> str:
    """``fits(name, w, b)``: weights and intercept of least mean(e^2) + l1*sum|w| + l2*sum(w^2) on ``train``."""
    values = ", ".join(f"('{name}', {l1!r}::DOUBLE, {l2!r}::DOUBLE)" for name, (l1, l2) in settings.items())
    return f"""
    settings(name, l1, l2) AS (VALUES {values}),
    z AS (SELECT list_append(x, y) AS z FROM train),
    covariances AS (SELECT i, j, covar_pop(z[i], z[j]) AS v FROM z, range(1, {width + 2}) a(i), range(1, {width + 2}) b(j) GROUP BY i, j),
    lines AS (SELECT i, list(v ORDER BY j) AS line FROM covariances GROUP BY i),
    c AS MATERIALIZED (SELECT list(line ORDER BY i) AS c FROM lines),
    means AS MATERIALIZED (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(z[i]) AS m FROM z, range(1, {width + 2}) a(i) GROUP BY i)),
    steps AS (
      SELECT name, l1, l2, 0 AS k, [0e0 for q in range({width})] AS w FROM settings
      UNION ALL
      SELECT name, l1, l2, k + 1, list_concat(w[1:j - 1], [sign(inner_) * greatest(abs(inner_) - l1 / 2, 0e0) / (c[j][j] + l2)], w[j + 1:{width}])
      FROM (SELECT *, c[j][{width + 1}] - list_dot_product(c[j][1:{width}], w) + c[j][j] * w[j] AS inner_
            FROM (SELECT steps.*, c, k % {width} + 1 AS j FROM steps, c WHERE k < {sweeps * width}))),
    fits AS (SELECT name, w, m[{width + 1}] - list_dot_product(m[1:{width}], w) AS b FROM steps, means WHERE k = {sweeps * width})"""


_FITTED = "list_dot_product(fits.w, x) + fits.b"
_PLAIN = {"linear_basic": search.LINEAR_VARIANTS["linear_basic"]}
_NAMES = feature_step_names(M, STEPS)
_FEATURES = "(VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(_NAMES, 1)) + ") f(i, feature)"


def _with(fits: dict[str, tuple[float, float]]) -> str:
    return f"WITH RECURSIVE {_XY_SQL}, {_fits_sql(fits)}"


def _fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named variants, with and without L1 and L2, solved from one pass."""
    rows = None
    for name, model in _variants(_sequences(spark, sf_dir).where("part = 'train'")).items():
        part = linear_importance(spark, model, M, STEPS).withColumn("model", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("model", "feature", r("weight").alias("weight"), r("bias", 5).alias("bias"))


_FIT_LINEAR_SQL = f"""{_with(search.LINEAR_VARIANTS)}
    SELECT name AS model, feature, round(w[i], 6) + 0e0 AS weight, round(b, 5) + 0e0 AS bias FROM fits, {_FEATURES}"""


def _linear_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each weight of the plain fit."""
    train = _sequences(spark, sf_dir).where("part = 'train'")
    table = linear_importance(spark, fit_linear(train, WIDTH), M, STEPS)
    return table.select("feature", r(F.abs("weight")).alias("importance"))


_LINEAR_IMPORTANCE_SQL = f"{_with(_PLAIN)} SELECT feature, round(abs(w[i]), 6) + 0e0 AS importance FROM fits, {_FEATURES}"


def _score_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _frames(spark, sf_dir)
    scored = score.score_sequences(_variants(train), score.guard_width(test, len(M)))
    return scored.select("event_id", "model", r("prediction", 5).alias("prediction"))


_SCORE_SQL = f"""{_with(search.LINEAR_VARIANTS)}
    SELECT event_id, name AS model, round({_FITTED}, 5) + 0e0 AS prediction FROM test, fits"""


def _evaluate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _frames(spark, sf_dir)
    table = score.evaluate_model(_variants(train, ["linear_with_elastic_net"])["linear_with_elastic_net"], test)
    return table.select(*[r(c, 5).alias(c) for c in table.columns])


_EVALUATE_SQL = f"""{_with({'m': search.LINEAR_VARIANTS['linear_with_elastic_net']})}, e AS (SELECT y, {_FITTED} - y AS e FROM test, fits)
    SELECT round(avg(e * e), 5) + 0e0 AS loss_mse, round(avg(abs(e) + ln(1 + exp(-2e0 * abs(e))) - ln(2e0)), 5) + 0e0 AS loss_log_cosh,
      round(avg(e * e), 5) + 0e0 AS mse, round(avg(abs(e)), 5) + 0e0 AS mae, round(1 - sum(e * e) / (count(*) * var_pop(y)), 5) + 0e0 AS r2 FROM e"""


_CONFIGS = [*search.variant_configs(), *search.linear_configs([0.0, 0.1, 1.0], [0.1, 1.0, 10.0])]


def _grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named variants and a grid over both penalties, all from one pass over the sequences."""
    runs = search.linear_grid(spark, _sequences(spark, sf_dir), F.col("part"), WIDTH, _CONFIGS)
    return runs.select(F.col("run_id").cast("bigint").alias("run_id"), "model_type", "config", r("test_loss", 5).alias("test_loss"), "reason")


_GRID_SEARCH_SQL = f"""{_with({str(i): (c['l1'], c['l2']) for i, c in enumerate(_CONFIGS)})},
    named(run_id, config) AS (VALUES {', '.join(f"({i}, '{search.settings_text(c)}')" for i, c in enumerate(_CONFIGS))})
    SELECT run_id::BIGINT AS run_id, 'linear' AS model_type, config, round(avg(({_FITTED} - y) * ({_FITTED} - y)), 5) + 0e0 AS test_loss, NULL::VARCHAR AS reason
    FROM test, fits JOIN named ON name = run_id::VARCHAR GROUP BY run_id, config"""


# The searched ranges: levels as layers, step as dropout rate, bins as units; the trees of the longest fit as its epochs.
_SPACE = {"max_depth": (1, 4, 1), "step": (0.1, 0.5, 0.1), "max_bins": (32, 128, 32)}
_LARGEST, _FACTOR = 20, 3


def _halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rungs of all brackets, with what must hold of their losses whatever the data."""
    train, test = _frames(spark, sf_dir)
    runs = search.hyperband(spark, train, test, _SPACE, _LARGEST, _FACTOR)
    before = Window.partitionBy("bracket", "config").orderBy("rung")
    runs = runs.withColumn("fell", F.coalesce(F.col("train_loss") <= F.lag("train_loss").over(before) + 1e-9, F.lit(True)))
    best, rest = F.max(F.when(F.col("kept"), F.col("loss"))), F.min(F.when(~F.col("kept"), F.col("loss")))
    return runs.groupBy("bracket", "rung", "budget", "fitted").agg(
        F.count(F.lit(1)).alias("settings"), F.count_if("kept").alias("kept"), F.coalesce(best <= rest, F.lit(True)).alias("best_kept"),
        F.every("fell").alias("train_loss_fell"), F.count("reason").alias("failed"),
    )


_HALVING_SQL = f"""WITH top AS (SELECT floor(ln({_LARGEST}) / ln({_FACTOR}) + 1e-9)::INTEGER AS deepest),
    brackets AS (SELECT deepest, s, ceil((deepest + 1) * {_FACTOR} ** s / (s + 1))::BIGINT AS n FROM top, range(0, deepest + 1) r(s)),
    rungs AS (SELECT (deepest - s)::INTEGER AS bracket, i::INTEGER AS rung, floor({_LARGEST} * {_FACTOR} ** i / {_FACTOR} ** s)::INTEGER AS budget,
      floor(n / {_FACTOR} ** i)::BIGINT AS settings, CASE WHEN i < s THEN floor(n / {_FACTOR} ** (i + 1)) ELSE 1 END::BIGINT AS kept FROM brackets, range(0, s + 1) q(i))
    SELECT bracket, rung, budget, budget - coalesce(lag(budget) OVER (PARTITION BY bracket ORDER BY rung), 0) AS fitted, settings, kept,
      TRUE AS best_kept, TRUE AS train_loss_fell, 0::BIGINT AS failed FROM rungs"""


# Metrics of few values, so that a tree may split at every one of them.
_SPLIT_NAMES = ("packets_lost", "packet_loss_rate", "speed")


def _fit_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test predictions of one split, the best over all values of all inputs."""
    indexed = _indexed(spark, sf_dir)
    made = materialize(to_frame(sequences.make_sequences(indexed, 2, _SPLIT_NAMES, carry=["event_id"])), "sequences")
    train, test = splits.split_sequential(made, 0.8, total=F.greatest(row_total(indexed) - 2, F.lit(0)))
    scored = predict(fit_nonlinear(train, max_depth=1, max_iter=1, max_bins=64), test)
    return scored.select("event_id", r("prediction", 5).alias("prediction"))


_FIT_NONLINEAR_SQL = f"""WITH {ORDERED_SQL},
    xy AS (SELECT event_id, idx - 2 AS seq, [{', '.join(f'lag({m}, {k}) OVER w' for k in (2, 1) for m in _SPLIT_NAMES)}] AS x, qoe AS y
      FROM ordered WINDOW w AS (ORDER BY idx)),
    n AS (SELECT count(*) - 2 AS n FROM ordered),
    train AS (SELECT xy.* FROM xy, n WHERE seq >= 0 AND seq < floor(n * 8e-1)),
    test AS (SELECT xy.* FROM xy, n WHERE seq >= 0 AND seq >= floor(n * 8e-1)),
    total AS (SELECT count(*) AS n_all, sum(y) AS s_all FROM train),
    vals AS (SELECT i, x[i] AS v, count(*) AS n, sum(y) AS s FROM train, range(1, {2 * len(_SPLIT_NAMES) + 1}) a(i) GROUP BY 1, 2),
    sides AS (SELECT i, v, lead(v) OVER w AS following, sum(n) OVER w AS nl, sum(s) OVER w AS sl FROM vals WINDOW w AS (PARTITION BY i ORDER BY v)),
    best AS (SELECT i, (v + following) / 2 AS edge, sl / nl AS low, (s_all - sl) / (n_all - nl) AS high FROM sides, total WHERE following IS NOT NULL
      ORDER BY sl * sl / nl + (s_all - sl) * (s_all - sl) / (n_all - nl) DESC LIMIT 1)
    SELECT event_id, round(CASE WHEN x[i] <= edge THEN low ELSE high END, 5) + 0e0 AS prediction FROM test, best"""


_SAVED = ("linear_basic", "linear_with_l2_reg")


def _saved(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with two saved models, and the test sequences."""
    folder = scratch_path(spark, "models")
    train, test = _frames(spark, sf_dir)
    for name, model in _variants(train, _SAVED).items():
        score.save_model(spark, name, model, folder)
    return folder, test


def _save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, test = _saved(spark, sf_dir)
    scored = score.score_sequences(score.load_models(spark, folder), test)
    means = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r(F.avg("prediction"), 5).alias("mean_prediction"))
    return means.join(score.registry(spark, folder).select("model", "model_type"), "model")


def _load_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two saved models, by name."""
    folder, test = _saved(spark, sf_dir)
    scored = score.score_sequences(score.load_models(spark, folder, _SAVED[1]), test)
    return scored.select("event_id", "model", r("prediction", 5).alias("prediction"))


_LOAD_MODELS_SQL = f"""{_with({_SAVED[1]: search.LINEAR_VARIANTS[_SAVED[1]]})}
    SELECT event_id, name AS model, round({_FITTED}, 5) + 0e0 AS prediction FROM test, fits"""


_SAVE_LOAD_SQL = f"""{_with({name: search.LINEAR_VARIANTS[name] for name in _SAVED})}
    SELECT name AS model, count(*) AS n, round(avg({_FITTED}), 5) + 0e0 AS mean_prediction, 'Linear Regressor' AS model_type FROM test, fits GROUP BY name"""


# Two attention heads over the metrics (metric by head), their biases and the vector that asks.
_ATTENTION_WEIGHTS = [[0.002, -0.001], [0.3, 0.2], [0.3, -0.2], [0.05, 0.1], [-0.01, 0.02]]
_ATTENTION_BIAS, _ATTENTION_CONTEXT = [0.1, -0.5], [1.5, -0.7]


def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequences.make_sequences(_indexed(spark, sf_dir), STEPS, M, carry=["event_id"])
    pooled = score.attention_pool(made, np.array(_ATTENTION_WEIGHTS), np.array(_ATTENTION_BIAS), np.array(_ATTENTION_CONTEXT))
    return pooled.select("event_id", *[r(F.col("pooled")[i], 5).alias(n) for i, n in enumerate(M)])


def _logit(k: int) -> str:
    """The score of the step ``k`` rows back."""
    heads = []
    for j, context in enumerate(_ATTENTION_CONTEXT):
        inner = " + ".join(f"lag({m}, {k}) OVER w * {_ATTENTION_WEIGHTS[i][j]!r}::DOUBLE" for i, m in enumerate(M))
        heads.append(f"tanh({inner} + {_ATTENTION_BIAS[j]!r}::DOUBLE) * {context!r}::DOUBLE")
    return f"exp({' + '.join(heads)}) AS s{k}, " + ", ".join(f"lag({m}, {k}) OVER w AS {m}{k}" for m in M)


_BACK = range(STEPS, 0, -1)
_ATTENTION_SQL = f"""WITH {ORDERED_SQL}, x AS (SELECT event_id, idx, {', '.join(_logit(k) for k in _BACK)} FROM ordered WINDOW w AS (ORDER BY idx))
    SELECT event_id, {', '.join(f"round(({' + '.join(f's{k} * {m}{k}' for k in _BACK)}) / ({' + '.join(f's{k}' for k in _BACK)}), 5) + 0e0 AS {m}" for m in M)}
    FROM x WHERE idx >= {STEPS}"""


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained elsewhere: step k counts k-fold, metric i by 2^-i."""
    made = sequences.make_sequences(_indexed(spark, sf_dir), STEPS, M, carry=["event_id"])
    weights = np.outer(np.arange(1, STEPS + 1), 0.5 ** np.arange(len(M)))
    scored = score.score_external(made, lambda x: (x * weights).sum(axis=(1, 2)), STEPS, len(M))
    return scored.select("event_id", r("prediction", 5).alias("prediction"))


_EXTERNAL_SQL = f"""WITH {ORDERED_SQL}, x AS (SELECT event_id, idx, {' + '.join(
        f'lag({m}, {STEPS - k}) OVER w * {(k + 1) * 0.5**i!r}::DOUBLE' for k in range(STEPS) for i, m in enumerate(M))} AS p
      FROM ordered WINDOW w AS (ORDER BY idx))
    SELECT event_id, round(p, 5) + 0e0 AS prediction FROM x WHERE idx >= {STEPS}"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = flows.evaluate_baseline(t.windows(spark, sf_dir), ["ts", "window_id"])
    return table.select(*[r(c).alias(c) for c in table.columns])


_BASELINE_SQL = f"""WITH {t.WINDOWS_SQL}, b AS (SELECT min("QoE") AS lo, max("QoE") AS hi FROM windows),
    z AS (SELECT ("QoE" - lo) / (hi - lo) AS q, lo, hi, row_number() OVER (ORDER BY ts, window_id) - 1 AS idx FROM windows, b),
    s AS (SELECT idx - 5 AS seq, q AS y, avg(q) OVER (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p, lo, hi, count(*) OVER () - 5 AS n FROM z),
    e AS (SELECT *, y * (hi - lo) + lo AS yo, p * (hi - lo) + lo AS po FROM s WHERE seq >= n - floor(n * 2e-1) AND seq >= 0)
    SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae,
      round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 6) AS r2, round(avg((po - yo) * (po - yo)), 6) AS mse_original,
      round(avg(abs(po - yo)), 6) AS mae_original, round(min(yo), 6) AS target_min, round(max(yo), 6) AS target_max FROM e"""


def _scaled_models(rows: DataFrame, names=_SAVED) -> tuple[dict, DataFrame]:
    """(linear models fitted on the first scaled sequences, scaler)."""
    indexed, scaler = flows.scaled_order(rows, M, ["ts", "event_id"])
    made = to_frame(sequences.make_sequences(indexed, STEPS, M))
    train, _ = splits.split_sequential(made, 0.8, total=F.greatest(row_total(indexed.select("idx")) - STEPS, F.lit(0)))
    return _variants(train, names), scaler


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear models fitted on the first rows and validated on all, target hidden; every file is counted."""
    rows = t.samples(spark, sf_dir).select(
        "event_id", F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("file"), "ts", *M, F.col("qoe").alias(TARGET)
    )
    models, scaler = _scaled_models(rows)
    predictions, table = flows.validate_models(rows, models, scaler, M, ["ts", "event_id"], STEPS)
    files = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("reason") == lookups.SHORT_HISTORY).alias("n_short"), F.count("prediction").alias("n_scored")
    )
    return table.join(files, "model").select(
        "model", "n_files", "n_short", "n_scored", *[r(c, 4).alias(c) for c in ("mse", "mae", "medae", "r2", "mean_error", "max_error")]
    )


def _scaled_sql(source: str) -> str:
    """``sc``: the rows of ``source`` in scaled units, with the bounds of the target."""
    bounds = ", ".join(f"min({m}) AS lo_{m}, max({m}) AS hi_{m}" for m in M)
    scaled = ", ".join(f"({m} - lo_{m}) / (hi_{m} - lo_{m}) AS s_{m}" for m in M)
    return f"""
    bounds AS (SELECT {bounds}, min(qoe) AS q0, max(qoe) AS q1 FROM {source}),
    sc AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, qoe, q0, q1, (qoe - q0) / (q1 - q0) AS sq, {scaled} FROM {source}, bounds),
    xy AS (SELECT event_id, idx - {STEPS} AS seq, {_x_sql('s_')} AS x, sq AS y FROM sc WINDOW w AS (ORDER BY idx)),{_PARTS_SQL.replace("ordered", "sc")}"""


_VALIDATE_SQL = f"""WITH RECURSIVE {t.SAMPLES_SQL}, {_scaled_sql('samples')}, {_fits_sql({n: search.LINEAR_VARIANTS[n] for n in _SAVED})},
    ending AS (SELECT idx, qoe, q0, q1, {_x_sql('s_', last=0)} AS x FROM sc WINDOW w AS (ORDER BY idx)),
    scored AS (SELECT name, idx, ({_FITTED}) * (q1 - q0) + q0 - qoe AS e FROM (SELECT * FROM ending WHERE idx >= {STEPS - 1}), fits),
    e AS (SELECT fits.name, sc.idx, qoe, e FROM sc CROSS JOIN fits LEFT JOIN scored ON scored.name = fits.name AND scored.idx = sc.idx)
    SELECT name AS model, count(*) AS n_files, count_if(idx < {STEPS - 1})::BIGINT AS n_short, count(e) AS n_scored,
      round(avg(e * e), 4) + 0e0 AS mse, round(avg(abs(e)), 4) + 0e0 AS mae, round(median(abs(e)), 4) + 0e0 AS medae,
      round(1 - sum(e * e) / (count(e) * var_pop(CASE WHEN e IS NOT NULL THEN qoe END)), 4) + 0e0 AS r2, round(avg(e), 4) + 0e0 AS mean_error,
      round(max(abs(e)), 4) + 0e0 AS max_error FROM e GROUP BY name"""


def _prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "prepared")
    counts = flows.prepare_validation(t.documents(spark, sf_dir), path, 0.6, seed=3)
    truth, masked, metadata = sinks.load_validation_pair(spark, path)
    summary = truth.join(metadata, "file").agg(
        F.struct(F.count(F.lit(1)).alias("n"), r(F.avg("ground_truth_qoe"), 7).alias("mean")).alias("s")
    ).scalar()
    return counts.withColumn("_s", summary).withColumn("n_masked", masked.where(F.col(TARGET).isNull()).agg(F.count(F.lit(1))).scalar()).select(
        "n_valid", "n_invalid", "n_masked", F.col("_s")["n"].alias("n_truth"), F.col("_s")["mean"].alias("mean_truth")
    )


_PREPARE_SQL = f"""WITH {t.DOCS_SQL}, ranked AS (SELECT d.*, w."QoE" AS q, row_number() OVER (ORDER BY substr(md5(d.file || ':3'), 1, 15), d.file) AS rn,
      count(*) OVER () AS n FROM docs d JOIN windows w ON d.window_id = w.window_id),
    chosen AS (SELECT *, window_id % 17 <> 3 AND window_id % 13 <> 5 AND window_id % 11 <> 7 AND window_id % 23 <> 6 AS ok FROM ranked WHERE rn <= floor(n * 6e-1))
    SELECT count_if(ok)::BIGINT AS n_valid, count_if(NOT ok)::BIGINT AS n_invalid, count_if(ok)::BIGINT AS n_masked,
      count_if(ok)::BIGINT AS n_truth, round(avg(q) FILTER (ok), 7) AS mean_truth FROM chosen"""


def _predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases scored by linear models of all other rows; a record with too little history has the reason."""
    rows = t.samples(spark, sf_dir).select("event_id", "event_type", "ts", *M, F.col("qoe").alias(TARGET))
    history, new = rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'")
    models, scaler = _scaled_models(history)
    scored = flows.predict_records(new.drop(TARGET), history, models, scaler, M, STEPS, "event_id")
    return scored.select("event_id", "model", r("prediction", 4).alias("prediction"), "reason")


_PREDICT_SQL = f"""WITH RECURSIVE {t.SAMPLES_SQL}, hist AS (SELECT * FROM samples WHERE event_type <> 'purchase'),
    {_scaled_sql('hist')}, {_fits_sql({n: search.LINEAR_VARIANTS[n] for n in _SAVED})},
    past AS (SELECT idx + 1 AS seen, [{', '.join(f'lag(s_{m}, {k}) OVER w' for k in range(STEPS - 2, -1, -1) for m in M)}] AS past FROM sc WINDOW w AS (ORDER BY idx)),
    placed AS (SELECT event_id, event_type = 'purchase' AS is_new, [{', '.join(f'({m} - lo_{m}) / (hi_{m} - lo_{m})' for m in M)}] AS own, q0, q1,
      sum(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_type <> 'purchase', event_id) AS seen FROM samples, bounds),
    joined AS (SELECT event_id, q0, q1, CASE WHEN placed.seen >= {STEPS - 1} THEN list_concat(past, own) END AS x FROM placed LEFT JOIN past ON past.seen = placed.seen WHERE is_new)
    SELECT event_id, name AS model, round(({_FITTED}) * (q1 - q0) + q0, 4) + 0e0 AS prediction,
      CASE WHEN x IS NULL THEN 'not enough history' END AS reason FROM joined, fits"""


# --- streams ------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern lets the table be one file or a folder of files."""
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = t.measured(_event_stream(spark, sf_dir)).select("ts", *M)
    made = stream_windowing.stream_windows(stream, width="10 minutes", delay="30 minutes", metrics=M)
    path = scratch_path(spark, "stream-windows")
    stream_windowing.run_available(made, path).awaitTermination()
    out = stream_windowing.read_output(spark, made, path)
    stats = [f"{m}_{s}" for m in M for s in STATS]
    return out.select(F.unix_seconds("window_start").alias("window_start"), "n_samples", *[r(c).alias(c) for c in stats])


_STREAM_WINDOWS_SQL = f"""WITH {t.SAMPLES_SQL}, s AS (SELECT *, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS w FROM samples)
    SELECT epoch(w)::BIGINT AS window_start, count(*) AS n_samples, {', '.join(
        f'round({fn}({m}), 6) + 0e0 AS {m}_{s}' for m in M
        for s, fn in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))}
    FROM s GROUP BY w HAVING w + INTERVAL '10 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '30 minutes'"""


#: Files the events arrive in, and how many of each hundred come one file later.
_ARRIVALS, _DELAYED = 3, 2


def _stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in three files, some of them one file later; late rows and scores of the others."""
    events = t.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ends = events.agg(F.struct(F.min("event_id").alias("low"), F.max("event_id").alias("high")).alias("e")).scalar()
    source, path = scratch_path(spark, "arrivals"), scratch_path(spark, "stream-score")
    stored = materialize(events.withColumn("_e", ends), "events")
    third = F.floor((F.col("event_id") - F.col("_e.low")) * _ARRIVALS / (F.col("_e.high") - F.col("_e.low") + 1))
    delay = (F.col("event_id") % 100 < _DELAYED).cast("int")
    dealt = stored.withColumn("arrival", F.least(third + delay, F.lit(_ARRIVALS - 1)))

    def mean_score(rows: DataFrame) -> DataFrame:
        return sequences.mean_pool(rows, 1).select("event_id", F.get("pooled", F.lit(0)).alias("prediction"))

    for arrival in range(_ARRIVALS):
        dealt.where(F.col("arrival") == arrival).drop("_e", "arrival").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        stream_scoring.stream_score(stream, path, ["user_id"], ["ts", "event_id"], ["value"], 4, mean_score).awaitTermination()
    scores = stream_scoring.read_scores(spark, path).select("event_id", r("prediction").alias("prediction"), F.lit(None).cast("string").alias("reason"))
    late = stream_scoring.read_late(spark, path).select("event_id", F.lit(None).cast("double").alias("prediction"), "reason")
    return scores.unionByName(late)


_STREAM_SCORE_SQL = f"""WITH ends AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events),
    dealt AS (SELECT events.*, least(floor((event_id - low) * {_ARRIVALS} / (high - low + 1)) + CASE WHEN event_id % 100 < {_DELAYED} THEN 1 ELSE 0 END, {_ARRIVALS - 1}) AS arrival FROM events, ends),
    placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM dealt),
    seen AS (SELECT *, max(place) OVER (PARTITION BY user_id ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM placed),
    x AS (SELECT event_id, avg(value) OVER w AS p, count(*) OVER w AS n FROM seen WHERE newest IS NULL OR place > newest
      WINDOW w AS (PARTITION BY user_id ORDER BY place ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(p, 6) + 0e0 AS prediction, NULL::VARCHAR AS reason FROM x WHERE n = 4
    UNION ALL SELECT event_id, NULL::DOUBLE, '{stream_scoring.LATE}' FROM seen WHERE place <= newest"""


QUERIES = {
    "evaluate_baseline": (_baseline, _BASELINE_SQL),
    "validate_models": (_validate, _VALIDATE_SQL),
    "prepare_validation": (_prepare, _PREPARE_SQL),
    "predict_records": (_predict, _PREDICT_SQL),
    "fit_linear": (_fit_linear, _FIT_LINEAR_SQL),
    "linear_importance": (_linear_importance, _LINEAR_IMPORTANCE_SQL),
    "fit_nonlinear": (_fit_nonlinear, _FIT_NONLINEAR_SQL),
    "score_sequences": (_score_sequences, _SCORE_SQL),
    "score_external": (_external, _EXTERNAL_SQL),
    "evaluate_model": (_evaluate_model, _EVALUATE_SQL),
    "grid_search": (_grid_search, _GRID_SEARCH_SQL),
    "successive_halving": (_halving, _HALVING_SQL),
    "save_model": (_save_load, _SAVE_LOAD_SQL),
    "load_models": (_load_models, _LOAD_MODELS_SQL),
    "attention_pool": (_attention, _ATTENTION_SQL),
    "stream_windows": (_stream_windows, _STREAM_WINDOWS_SQL),
    "stream_score": (_stream_score, _STREAM_SCORE_SQL),
}
