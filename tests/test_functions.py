from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.functions import numeric, text, timeparse


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_exact_round_agrees_with_binary_rounding(spark, digits):
    rng = random.Random(digits)
    ties = [(2 * k + 1) / (2 * 10**digits) for k in range(-400, 400)]
    values = ties + [rng.uniform(-2000, 2000) for _ in range(2000)] + [2.675, 1.005, 0.125, 2.5, 3.5, -0.5, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select("x", numeric.exact_round(F.col("x"), digits).alias("y")).collect()
    assert [(r.x, r.y) for r in got if r.y != round(r.x, digits)] == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200))
def test_exact_round_property(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = rows.select("x", numeric.exact_round(F.col("x"), 2).alias("y")).collect()
    assert all(r.y == round(r.x, 2) for r in got)


def test_try_double(spark):
    rows = spark.createDataFrame([("1.5",), (" 2 ",), ("n/a",), ("NaN",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(numeric.try_double(F.col("s"))).collect()] == [1.5, 2.0, None, None, None, None]


def test_clip_round_bounds(spark):
    rows = spark.createDataFrame([(-3.0,), (120.0,), (55.12345678,)], "x double")
    assert [r[0] for r in rows.select(numeric.clip_round(F.col("x"))).collect()] == [0.0, 100.0, 55.123457]


def test_log_cosh_does_not_overflow(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (-2.0,), (5000.0,)], "e double")
    got = [r[0] for r in rows.select(numeric.log_cosh(F.col("e"))).collect()]
    want = [0.0, math.log(math.cosh(1)), math.log(math.cosh(2)), 5000 - math.log(2)]
    assert got == pytest.approx(want)


def test_coefficient_of_variation_of_zero_mean(spark):
    row = spark.range(1).select(numeric.coefficient_of_variation(F.lit(1.0), F.lit(0.0)).alias("cv")).first()
    assert row.cv is None


def test_timestamps(spark):
    rows = spark.createDataFrame(
        [("20250402121954",), ("20250402122092",), ("2025-04-02",), (None,)], "s string"
    )
    got = [r[0] for r in rows.select(timeparse.ts_digits(timeparse.parse_ts(F.col("s")))).collect()]
    assert got == ["20250402121954", None, None, None]
    number = spark.range(1).select(timeparse.ts_digits(timeparse.parse_ts(F.lit(20250402121954)))).first()[0]
    assert number == "20250402121954"
    digits = spark.range(1).select(timeparse.normalize_ts_digits(F.lit("2025-04-02 12:19:54"))).first()[0]
    assert digits == "20250402121954"


def test_ts_from_filename(spark):
    rows = spark.createDataFrame([("20250402121954.json",), ("notes.json",), ("",)], "f string")
    assert [r[0] for r in rows.select(timeparse.ts_from_filename(F.col("f"))).collect()] == [20250402121954, 0, 0]


def test_peak_hours(spark):
    got = [r[0] for r in spark.range(24).orderBy("id").select(timeparse.peak_hour(F.col("id"))).collect()]
    assert [h for h, p in enumerate(got) if p] == [7, 8, 9, 17, 18, 19]


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("models/Linear_basic.h5", "Linear Regressor"), ("dnn_deep.h5", "Simple DNN"), ("lstm.h5", "LSTM"),
        ("gru_wide.h5", "GRU"), ("transformer.h5", "Transformer"), ("svr.h5", "Unknown"), ("gru/other.h5", "Unknown"),
        ("linear_dnn.h5", "Linear Regressor"),
    ],
)
def test_classify_model(spark, path, kind):
    assert spark.range(1).select(text.classify_model(F.lit(path))).first()[0] == kind


@pytest.mark.parametrize(
    ("name", "base", "step", "stat"),
    [
        ("jitter_mean_t-5", "jitter_mean", 5, "_mean"), ("f3_t-1", "f3", 1, None), ("jitter_mean", "jitter", None, "_mean"),
        ("speed_max", "speed", None, "_max"), ("f7", "f7", None, None), ("a_t-x", "a", None, None),
    ],
)
def test_feature_names(spark, name, base, step, stat):
    c = F.lit(name)
    row = spark.range(1).select(text.base_feature(c), text.lag_step(c), text.stat_suffix(c)).first()
    assert tuple(row) == (base, step, stat)


def test_labels_and_null_literals(spark):
    rows = spark.createDataFrame([("null",), ("",), ("abc",), ("0123456789",), ("0123456789x",)], "s string")
    got = rows.select(text.null_literal(F.col("s")).alias("n"), text.short_label(F.col("s")).alias("l")).collect()
    assert [r.n for r in got] == [None, None, "abc", "0123456789", "0123456789x"]
    assert [r.l for r in got][3:] == ["0123456789", "0123456789..."]
