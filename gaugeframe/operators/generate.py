"""Measurement generator. Draws depend on the row's key and the seed, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import exact_round, qoe_formula
from gaugeframe.functions.timeparse import peak_hour, ts_digits
from gaugeframe.schemas import METRICS, SAMPLES_PER_WINDOW, TARGET

# Seconds between windows and between sub-samples.
WINDOW_SECONDS = 10
SAMPLE_SECONDS = 2


def _digests(key: Column, seed: int) -> Column:
    text = key.cast("string")
    return F.concat(F.md5(F.concat(text, F.lit(f":{seed}:0"))), F.md5(F.concat(text, F.lit(f":{seed}:1"))))


def _draw(digests: Column, n: int) -> Column:
    """The n-th of eight uniform numbers in [0, 1)."""
    return F.conv(F.substring(digests, 1 + 8 * n, 8), 16, 10).cast("double") / 4294967296.0


def _raw(digests: Column) -> Column:
    names = ("loss", "lost", "jitter", "throughput", "speed", "extra", "noise")
    return F.struct(*[_draw(digests, i).alias(name) for i, name in enumerate(names)])


def _spread(u: Column) -> Column:
    # Ranges of the simulated metrics.
    return F.struct(
        (u["loss"] * 5.0).alias("loss"),
        (u["lost"] * 5.0).alias("lost"),
        (u["jitter"] * 15.0 + 15.0).alias("jitter"),
        (u["throughput"] * 1000.0 + 600.0).alias("throughput"),
        (u["speed"] * 60.0).alias("speed"),
        (u["extra"] * 5.0).alias("extra"),
        (u["noise"] * 2.0 - 1.0).alias("noise"),
    )


def _measured(s: Column, peak: Column) -> Column:
    extra = F.when(peak, s["extra"]).otherwise(F.lit(0.0))
    return F.struct(
        exact_round(s["throughput"], 1).alias("throughput"),
        exact_round(s["lost"], 1).alias("packets_lost"),
        exact_round(s["loss"], 2).alias("packet_loss_rate"),
        (exact_round(s["jitter"], 3) + extra).alias("jitter"),
        exact_round(s["speed"], 0).alias("speed"),
        s["noise"].alias("noise"),
        peak.alias("peak"),
    )


def _score(m: Column) -> Column:
    return qoe_formula(m["packet_loss_rate"], m["jitter"], m["throughput"], m["speed"], m["peak"], m["noise"])


def generate_measurements(rows: DataFrame, key: str, ts: str = "ts", seed: int = 0) -> DataFrame:
    """One measurement with its score for every row."""
    staged = (
        rows.withColumn("_d", _digests(F.col(key), seed))
        .withColumn("_s", _spread(_raw(F.col("_d"))))
        .withColumn("_m", _measured(F.col("_s"), peak_hour(F.hour(ts))))
    )
    return staged.select(
        *rows.columns, *[F.col("_m")[m].alias(m) for m in METRICS["new"]], _score(F.col("_m")).alias("qoe")
    )


def window_starts(spark: SparkSession, start: str, n: int) -> DataFrame:
    """(window_id, start_ts) every ten seconds from ``start`` (14 digits)."""
    first = F.to_timestamp(F.lit(start), "yyyyMMddHHmmss")
    return spark.range(n).select(
        F.col("id").alias("window_id"),
        F.timestamp_seconds(F.unix_seconds(first) + F.col("id") * WINDOW_SECONDS).alias("start_ts"),
    )


def generate_windows(
    starts: DataFrame, seed: int = 0, inference: bool = False, n_samples: int = SAMPLES_PER_WINDOW
) -> DataFrame:
    """Windows of ``n_samples`` sub-samples two seconds apart from (window_id, start_ts).

    The window time is that of its last sub-sample; ``inference`` leaves the target NULL.
    Sub-samples are rows while they are drawn, which keeps that work in generated code; the
    rows of a window lie in one task and are folded there before the shuffle.
    """
    slots = starts.select("window_id", "start_ts", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_slot"))
    first = F.unix_seconds(F.col("start_ts").cast("timestamp"))
    rows = slots.select(
        "window_id",
        (F.col("window_id") * n_samples + F.col("_slot")).alias("_key"),
        F.timestamp_seconds(first + F.col("_slot") * SAMPLE_SECONDS).alias("ts"),
    )
    value = F.struct(*[F.col(m) for m in METRICS["new"]])
    folded = generate_measurements(rows, "_key", seed=seed).groupBy("window_id").agg(
        F.max("ts").alias("ts"),
        F.sort_array(F.collect_list(F.struct("_key", "ts", value.alias("v"), "qoe"))).alias("_rows"),
    )
    mean = F.aggregate("_rows", F.lit(0.0), lambda acc, s: acc + s["qoe"]) / float(n_samples)
    return folded.select(
        "window_id",
        F.concat(ts_digits(F.col("ts")), F.lit(".json")).alias("file"),
        "ts",
        (F.lit(None).cast("double") if inference else mean).alias(TARGET),
        F.transform("_rows", lambda s: F.struct(ts_digits(s["ts"]).alias("key"), s["v"].alias("v"))).alias("samples"),
    )
