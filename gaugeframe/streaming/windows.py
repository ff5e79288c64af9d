"""Tumbling measurement windows over a stream of sub-samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeframe.schemas import METRICS


def stream_windows(
    samples: DataFrame,
    ts: str = "ts",
    width: str = "10 seconds",
    delay: str = "30 seconds",
    metrics: Sequence[str] = METRICS["new"],
) -> DataFrame:
    """Statistics per tumbling window; a window is emitted once the watermark has passed its end."""
    aggregates = []
    for m in metrics:
        aggregates += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    grouped = samples.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n_samples"), *aggregates).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_samples",
        *[f"{m}_{s}" for m in metrics for s in ("mean", "std", "min", "max")],
    )


def run_available(stream: DataFrame, path: str) -> StreamingQuery:
    """Process what has arrived into Parquet below ``path`` and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_output(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
