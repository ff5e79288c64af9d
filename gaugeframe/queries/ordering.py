"""Order, sequences, splits, samples and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.models.search import GRIDS, GRID_COLUMNS, config_key, param_grid
from gaugeframe.operators import lookups, sequences, splits
from gaugeframe.plans.ordered import dense_index, row_total, series_position
from gaugeframe.queries import tables as t
from gaugeframe.queries.tables import r
from gaugeframe.schemas import METRICS, TARGET, feature_names
from gaugeframe.session import materialize

M = METRICS["new"]
S = 5


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.samples(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", *M, F.col("qoe").alias(TARGET))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(_series(spark, sf_dir), ["ts", "event_id"])


ORDERED_SQL = t.SAMPLES_SQL + ", ordered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM samples)"


def _dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("event_id", "idx")


_DENSE_INDEX_SQL = f"WITH {ORDERED_SQL} SELECT event_id, idx FROM ordered"


def _series_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = dense_index(_series(spark, sf_dir).select("event_id", "user_id", "ts"), ["user_id", "ts", "event_id"])
    return series_position(indexed, ["user_id"]).select("event_id", "pos", "n_rows")


_SERIES_POSITION_SQL = f"""WITH {t.SAMPLES_SQL}
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n_rows FROM samples"""


def _steps(df: DataFrame, length: int, width: int, *keep) -> DataFrame:
    """First and last value of the oldest and newest step, and the sum over the sequence."""
    total = F.aggregate(F.flatten("X"), F.lit(0.0), lambda acc, v: acc + v)
    return df.select(
        *keep, F.col("X")[0][0].alias("oldest"), F.col("X")[length - 1][width - 1].alias("newest"),
        r(total, 4).alias("total"), F.size("X").cast("bigint").alias("n_steps"),
    )


def _lags(first: int, last: int, window: str) -> str:
    """SQL of the same columns: ``first``..``last`` are the lags of the oldest and newest step."""
    total = " + ".join(f"lag({m}, {k}) OVER {window}" for k in range(last, first + 1) for m in M)
    return (
        f"lag(throughput, {first}) OVER {window} AS oldest, lag(speed, {last}) OVER {window} AS newest, "
        f"round({total}, 4) AS total, {first - last + 1}::BIGINT AS n_steps"
    )


def _make_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequences.make_sequences(_ordered(spark, sf_dir), S, M, carry=["event_id"])
    return _steps(made, S, len(M), "seq", "event_id", "y")


_MAKE_SEQUENCES_SQL = f"""WITH {ORDERED_SQL}, x AS (
      SELECT idx, idx - {S} AS seq, event_id, qoe AS y, {_lags(S, 1, 'w')} FROM ordered WINDOW w AS (ORDER BY idx))
    SELECT * EXCLUDE (idx) FROM x WHERE idx >= {S}"""


def _keyed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = dense_index(_series(spark, sf_dir), ["user_id", "ts", "event_id"])
    made = sequences.make_sequences(indexed, S, M, carry=["event_id"], keys=["user_id"])
    return _steps(made, S, len(M), "user_id", "event_id", "y")


_KEYED_SQL = f"""WITH {t.SAMPLES_SQL}, x AS (
      SELECT user_id, event_id, qoe AS y, {_lags(S, 1, 'w')}, row_number() OVER w AS rn FROM samples
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT * EXCLUDE (rn) FROM x WHERE rn > {S}"""


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequences.make_trailing_sequences(_ordered(spark, sf_dir), S, M, carry=["event_id"])
    return _steps(made, S, len(M), "event_id", "idx")


_TRAILING_SQL = f"""WITH {ORDERED_SQL}, x AS (
      SELECT event_id, idx, {_lags(S - 1, 0, 'w')} FROM ordered WINDOW w AS (ORDER BY idx))
    SELECT * FROM x WHERE idx >= {S - 1}"""


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.windows(spark, sf_dir).select("window_id", "file")
    made = sequences.fallback_sequences(files, _series(spark, sf_dir), 3, M, ["ts", "event_id"])
    return _steps(made, 3, len(M), "window_id", "file")


_FALLBACK_SQL = f"""WITH {ORDERED_SQL}, w2 AS (SELECT DISTINCT window_id, strftime(max(ts) OVER (PARTITION BY window_id), '%Y%m%d%H%M%S') || '.json' AS file FROM samples),
    last_rows AS (SELECT * FROM ordered ORDER BY idx DESC LIMIT 3)
    SELECT window_id, file, (SELECT arg_min(throughput, idx) FROM last_rows) AS oldest, (SELECT arg_max(speed, idx) FROM last_rows) AS newest,
      (SELECT round(sum({' + '.join(M)}), 4) FROM last_rows) AS total, 3::BIGINT AS n_steps FROM w2"""


def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.history_tail(_series(spark, sf_dir), S - 1, ["ts", "event_id"]).select("event_id", "throughput")


_TAIL_SQL = f"WITH {t.SAMPLES_SQL} SELECT event_id, throughput FROM samples ORDER BY ts DESC, event_id DESC LIMIT {S - 1}"


def _flatten_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every flattened position over all sequences, under its step name."""
    made = sequences.flatten_sequence(sequences.make_sequences(_ordered(spark, sf_dir), 3, M))
    names = F.array(*[F.lit(n) for n in sequences.feature_step_names(M, 3)])
    cells = made.select(F.posexplode("flat").alias("position", "value"))
    means = cells.groupBy("position").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return means.select(
        F.col("position").cast("bigint").alias("position"), names[F.col("position")].alias("feature"),
        r("mean").alias("mean"), "n",
    )


_FLATTEN_SEQUENCE_SQL = f"""WITH {ORDERED_SQL}, n AS (SELECT count(*) AS n FROM ordered)
    {' UNION ALL '.join(
        f"SELECT {step * len(M) + j}::BIGINT AS position, '{m}_t-{3 - step}' AS feature, round(avg({m}), 6) AS mean, count({m}) AS n "
        f"FROM ordered, n WHERE idx >= {step} AND idx < n.n - 3 + {step}"
        for step in range(3) for j, m in enumerate(M))}"""


def _step_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each possible step name occurs among the weights."""
    names = sequences.feature_step_names(feature_names(stats=True), S)
    known = spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "feature"))
    seen = t.weights(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return known.join(seen, "feature", "left").select(
        F.col("position").cast("bigint").alias("position"), "feature", F.coalesce("n", F.lit(0)).alias("n")
    )


_STEP_NAMES_SQL = f"""WITH {t.WEIGHTS_SQL}, bases AS (
      SELECT unnest([{', '.join(f"'f{i}'" for i in range(25))}, {', '.join(f"'{n}'" for n in t.STAT_FEATURES)}]) AS base,
        generate_subscripts([{', '.join(['1'] * 45)}], 1) - 1 AS j),
    names AS (SELECT (s * 45 + j)::BIGINT AS position, base || '_t-' || (5 - s)::VARCHAR AS feature FROM bases, range(5) x(s)),
    seen AS (SELECT feature, count(*) AS n FROM weights GROUP BY feature)
    SELECT position, names.feature, coalesce(n, 0) AS n FROM names LEFT JOIN seen ON names.feature = seen.feature"""


def _mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequences.mean_pool(sequences.make_sequences(_ordered(spark, sf_dir), S, M, carry=["event_id"]), len(M))
    return made.select("event_id", *[r(F.col("pooled")[j]).alias(f"mean_{m}") for j, m in enumerate(M)])


_MEAN_POOL_SQL = f"""WITH {ORDERED_SQL}, x AS (SELECT event_id, idx,
      {', '.join(f'round(avg({m}) OVER w, 6) AS mean_{m}' for m in M)} FROM ordered
      WINDOW w AS (ORDER BY idx ROWS BETWEEN {S} PRECEDING AND 1 PRECEDING))
    SELECT * EXCLUDE (idx) FROM x WHERE idx >= {S}"""


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as the new records, everything else as the history."""
    rows = _series(spark, sf_dir)
    made = sequences.asof_history(rows.where("event_type = 'purchase'"), rows.where("event_type <> 'purchase'"), 4, M, "event_id")
    return made.select("event_id", *[F.col("X")[i][j].alias(f"{m}_{i}") for i in range(4) for j, m in enumerate(M)])


_ASOF_SQL = f"""WITH {t.SAMPLES_SQL},
    u AS (SELECT *, event_type <> 'purchase' AS is_history FROM samples),
    placed AS (SELECT *, sum(CASE WHEN is_history THEN 1 ELSE 0 END) OVER (ORDER BY ts, is_history, event_id) AS seen FROM u),
    hist AS (SELECT seen AS h, * FROM placed WHERE is_history)
    SELECT p.event_id, {', '.join(f"{side}.{m} AS {m}_{i}" for i, side in enumerate('abcp') for m in M)}
    FROM placed p JOIN hist a ON a.h = p.seen - 2 JOIN hist b ON b.h = p.seen - 1 JOIN hist c ON c.h = p.seen
    WHERE NOT p.is_history"""


def _with_sequences(spark: SparkSession, sf_dir: str):
    indexed = _ordered(spark, sf_dir)
    # Stored: the parts of a split are read separately.
    made = materialize(sequences.make_sequences(indexed, S, M), "sequences")
    return made, F.greatest(row_total(indexed) - S, F.lit(0))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, total = _with_sequences(spark, sf_dir)
    train, test = splits.split_sequential(made, 0.8, total=total)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return _split_summary(both)


def _split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), r(F.sum("y"), 4).alias("sum_y")
    )


_SEQ_SQL = ORDERED_SQL + f""", seqs AS (SELECT idx - {S} AS seq, qoe AS y FROM ordered WHERE idx >= {S}),
    total AS (SELECT count(*) AS n FROM seqs)"""
_SUMMARY_SQL = "SELECT split, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, round(sum(y), 4) AS sum_y FROM x GROUP BY split"
_SPLIT_SQL = f"""WITH {_SEQ_SQL}, x AS (
      SELECT *, CASE WHEN seq < floor(n * 8e-1) THEN 'train' ELSE 'test' END AS split FROM seqs, total) {_SUMMARY_SQL}"""


def _tail_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, total = _with_sequences(spark, sf_dir)
    return splits.tail_test(made, 0.2, total=total).select("seq", "y")


_TAIL_TEST_SQL = f"WITH {_SEQ_SQL} SELECT seq, y FROM seqs, total WHERE seq >= n - floor(n * 2e-1)"


def _validation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, total = _with_sequences(spark, sf_dir)
    return _split_summary(splits.validation_tail(made, total=total))


_VALIDATION_TAIL_SQL = f"""WITH {_SEQ_SQL}, x AS (
      SELECT *, CASE WHEN seq < floor(floor(n * 8e-1) * 8e-1) THEN 'train' WHEN seq < floor(n * 8e-1) THEN 'validation'
        ELSE 'test' END AS split FROM seqs, total) {_SUMMARY_SQL}"""


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("file"), "value")
    return splits.sample_exact(rows, "file", 0.37, seed=11)


_SAMPLE_SQL = """WITH x AS (SELECT event_id::VARCHAR || '.json' AS file, value FROM events),
    ranked AS (SELECT *, row_number() OVER (ORDER BY substr(md5(file || ':11'), 1, 15), file) AS rn, count(*) OVER () AS n FROM x)
    SELECT file, value FROM ranked WHERE rn <= floor(n * 37e-2)"""


def _truth_tables(spark: SparkSession, sf_dir: str):
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit(".json"))
    preds = t.table(spark, sf_dir, "lineitem").select(
        name("l_orderkey").alias("file"), (F.col("l_suppkey") % 3).cast("string").alias("model"),
        (F.col("l_extendedprice") / 1100.0).alias("prediction"),
    )
    truth = t.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        name("o_orderkey").alias("file"), (F.col("o_totalprice") / 5000.0).alias("ground_truth")
    )
    return preds, truth


_TRUTH_SQL = """preds AS (SELECT l_orderkey::VARCHAR || '.json' AS file, (l_suppkey % 3)::VARCHAR AS model, l_extendedprice / 11e2 AS prediction FROM lineitem),
    truth AS (SELECT o_orderkey::VARCHAR || '.json' AS file, o_totalprice / 5e3 AS ground_truth FROM orders WHERE o_orderstatus <> 'P')"""


def _join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lookups.join_truth(*_truth_tables(spark, sf_dir))
    return joined.groupBy("file", "model").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("prediction") - F.col("ground_truth"))).alias("sum_error")
    )


_JOIN_TRUTH_SQL = f"""WITH {_TRUTH_SQL} SELECT file, model, count(*) AS n, round(sum(prediction - ground_truth), 6) AS sum_error
    FROM preds JOIN truth USING (file) GROUP BY file, model"""


def _in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, truth = _truth_tables(spark, sf_dir)
    kept = lookups.truth_in_scope(preds, truth)
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r(F.sum("prediction"), 4).alias("sum_prediction"))


_IN_SCOPE_SQL = f"""WITH {_TRUTH_SQL} SELECT model, count(*) AS n, round(sum(prediction), 4) AS sum_prediction
    FROM preds WHERE file IN (SELECT file FROM truth) GROUP BY model"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that match a row, and every eighth one that does not."""
    wid = F.col("window_id")
    name = F.when(wid % 8 == 3, F.concat(F.lit("x"), F.col("file"))).otherwise(F.col("file"))
    return t.windows(spark, sf_dir).select("window_id", name.alias("file"), TARGET)


def _file_to_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.join_file_to_row(_files(spark, sf_dir), _ordered(spark, sf_dir)).select("window_id", "file", "idx")


_FILES_SQL = ORDERED_SQL + """, w3 AS (SELECT window_id, max(ts) AS ts, avg(qoe) AS q FROM samples GROUP BY window_id),
    files AS (SELECT window_id, CASE WHEN window_id % 8 = 3 THEN 'x' ELSE '' END || strftime(ts, '%Y%m%d%H%M%S') || '.json' AS file, q FROM w3),
    first_rows AS (SELECT strftime(ts, '%Y%m%d%H%M%S') AS digits, min(idx) AS idx FROM ordered GROUP BY 1)"""
_FILE_TO_ROW_SQL = f"""WITH {_FILES_SQL}
    SELECT window_id, file, idx FROM files JOIN first_rows ON split_part(file, '.', 1) = digits"""


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    status = lookups.file_status(files, files.where(F.col(TARGET) >= 75.0), _ordered(spark, sf_dir), 100)
    return lookups.skipped_files(status)


_SKIPPED_SQL = f"""WITH {_FILES_SQL}, known AS (SELECT DISTINCT file FROM files WHERE q >= 75e0),
    status AS (SELECT CASE WHEN files.file NOT IN (SELECT file FROM known) THEN 'not in metadata' WHEN idx IS NULL THEN 'no matching timestamp'
      WHEN idx < 99 THEN 'not enough history' END AS reason FROM files LEFT JOIN first_rows ON split_part(file, '.', 1) = digits)
    SELECT reason, count(*) AS n_files FROM status WHERE reason IS NOT NULL GROUP BY reason"""


def _param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each setting was run and its mean loss."""
    runs = t.runs_text(spark, sf_dir).withColumn("loss", F.col("test_loss").try_cast("double")).withColumn("config_id", config_key())
    done = runs.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_runs"), r(F.avg("loss")).alias("mean_loss"))
    return param_grid(spark).join(done, "config_id", "left").select(
        "model_type", *GRID_COLUMNS, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "mean_loss"
    )


def _grid_sql() -> str:
    cast = {"seq_length": "INTEGER", "hidden_units": "INTEGER", "num_layers": "INTEGER", "dropout_rate": "DOUBLE",
            "learning_rate": "DOUBLE", "bidirectional": "BOOLEAN", "num_heads": "INTEGER", "ff_dim": "INTEGER"}
    parts = []
    for model_type, grid in GRIDS.items():
        cols = ", ".join(f"v_{c}.v AS {c}" if c in grid else f"NULL::{k} AS {c}" for c, k in cast.items())
        lists = ", ".join(f"(SELECT unnest([{', '.join(str(v) for v in vs)}]::{cast[c]}[]) AS v) v_{c}" for c, vs in grid.items())
        parts.append(f"SELECT '{model_type}' AS model_type, {cols} FROM {lists}")
    on = " AND ".join(f"g.{c} IS NOT DISTINCT FROM r.{c}" for c in ("model_type", *cast))
    return f"""WITH {t.RUNS_SQL}, grid AS ({' UNION ALL '.join(parts)}),
      done AS (SELECT model_type, {', '.join(cast)}, count(*) AS n_runs, round(avg(test_loss), 6) AS mean_loss FROM runs GROUP BY ALL)
    SELECT {', '.join(f'g.{c}' for c in ('model_type', *cast))}, coalesce(n_runs, 0) AS n_runs, mean_loss FROM grid g LEFT JOIN done r ON {on}"""


QUERIES = {
    "dense_index": (_dense_index, _DENSE_INDEX_SQL),
    "series_position": (_series_position, _SERIES_POSITION_SQL),
    "make_sequences": (_make_sequences, _MAKE_SEQUENCES_SQL),
    "make_sequences_keyed": (_keyed_sequences, _KEYED_SQL),
    "make_trailing_sequences": (_trailing, _TRAILING_SQL),
    "fallback_sequences": (_fallback, _FALLBACK_SQL),
    "history_tail": (_tail, _TAIL_SQL),
    "flatten_sequence": (_flatten_sequence, _FLATTEN_SEQUENCE_SQL),
    "feature_step_names": (_step_names, _STEP_NAMES_SQL),
    "mean_pool": (_mean_pool, _MEAN_POOL_SQL),
    "asof_history": (_asof, _ASOF_SQL),
    "split_sequential": (_split, _SPLIT_SQL),
    "tail_test": (_tail_test, _TAIL_TEST_SQL),
    "validation_tail": (_validation_tail, _VALIDATION_TAIL_SQL),
    "sample_exact": (_sample, _SAMPLE_SQL),
    "join_truth": (_join_truth, _JOIN_TRUTH_SQL),
    "truth_in_scope": (_in_scope, _IN_SCOPE_SQL),
    "join_file_to_row": (_file_to_row, _FILE_TO_ROW_SQL),
    "skipped_files": (_skipped, _SKIPPED_SQL),
    "param_grid": (_param_grid, _grid_sql()),
}
