"""Window features: flattened sub-samples, statistics, targets, time fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import exact_round
from gaugeframe.functions.timeparse import hour_of, minute_of, peak_hour, weekday_of
from gaugeframe.schemas import (
    FLAT_METRICS,
    METRICS,
    SAMPLES_PER_WINDOW,
    STAT_METRICS,
    STATS,
    TARGET,
    TIMESTAMP,
)
from gaugeframe.sources.windows import sample_means


def _within(samples: str, n_samples: int, value: Column) -> Column:
    """``value``, or an error for a window longer than the layout: no sub-sample is dropped silently."""
    message = F.lit(f"a window has more than {n_samples} sub-samples; raise n_samples")
    return F.when(F.size(samples) > n_samples, F.raise_error(message)).otherwise(value)


def flatten_samples(
    windows: DataFrame, layout: str = "new", n_samples: int = SAMPLES_PER_WINDOW, samples: str = "samples"
) -> DataFrame:
    """Sub-samples as columns f0..fK in key order; missing sub-samples give NULL.

    The layout fixes the number of columns, so no pass over the data is needed for it.
    Size ``n_samples`` to the longest window of the feed; a longer one is an error.
    """
    metrics = METRICS[layout]
    columns = {
        f"f{i * len(metrics) + j}": _within(samples, n_samples, F.get(F.col(samples), F.lit(i))["v"][metric])
        for i in range(n_samples)
        for j, metric in enumerate(metrics)
    }
    return windows.withColumns(columns)


def widest_window(windows: DataFrame, samples: str = "samples") -> int:
    """The number of sub-samples of the longest window, by one aggregate."""
    return windows.agg(F.max(F.size(samples))).first()[0] or 0


def _present(samples: str, metric: str) -> Column:
    return F.filter(F.transform(samples, lambda s: s["v"][metric]), lambda x: x.isNotNull())


def window_stats(windows: DataFrame, layout: str = "new", samples: str = "samples") -> DataFrame:
    """<metric>_{mean,std,min,max} over the sub-samples of each window, inside the row.

    The deviation is the population one, computed around the mean.
    """
    metrics = STAT_METRICS[layout]
    keep = windows.columns
    df = windows.withColumns({f"_a_{m}": _present(samples, m) for m in metrics})
    df = df.withColumns(
        {
            f"{m}_mean": F.try_divide(
                F.aggregate(f"_a_{m}", F.lit(0.0), lambda acc, x: acc + x), F.size(f"_a_{m}")
            )
            for m in metrics
        }
    )
    out = list(keep)
    for m in metrics:
        mean, values = F.col(f"{m}_mean"), F.col(f"_a_{m}")
        spread = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        stats: dict[str, Column] = {
            "mean": mean,
            "std": F.sqrt(F.try_divide(spread, F.size(values))),
            "min": F.array_min(values),
            "max": F.array_max(values),
        }
        out += [stats[s].alias(f"{m}_{s}") for s in STATS]
    return df.select(*out)


def window_stats_tall(
    samples: DataFrame, keys: Sequence[str], metrics: Sequence[str] = STAT_METRICS["new"]
) -> DataFrame:
    """The same statistics from one row per sub-sample; combined before the shuffle."""
    aggregates = []
    for m in metrics:
        aggregates += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_std"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    return samples.groupBy(*keys).agg(*aggregates)


def window_means(windows: DataFrame, samples: str = "samples") -> DataFrame:
    """Means of the four flat metrics, rounded to 2 digits; NULL without values."""
    keep = windows.columns
    raw = windows.withColumns({f"_m_{m}": sample_means(F.col(samples), m) for m in FLAT_METRICS})
    return raw.select(*keep, *[exact_round(F.col(f"_m_{m}"), 2).alias(m) for m in FLAT_METRICS])


def window_target(
    samples: DataFrame, keys: Sequence[str], score: str = "qoe", inference: bool = False
) -> DataFrame:
    """QoE of a window: the mean of its sub-sample scores, NULL for windows to be scored."""
    if inference:
        return samples.groupBy(*keys).agg(F.lit(None).cast("double").alias(TARGET))
    return samples.groupBy(*keys).agg(F.avg(score).alias(TARGET))


def temporal_fields(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, minute, day_of_week (Monday 0); columns already there are kept."""
    made = {"hour": hour_of, "minute": minute_of, "day_of_week": weekday_of}
    return df.withColumns({name: fn(F.col(ts)) for name, fn in made.items() if name not in df.columns})


def peak_hour_flag(df: DataFrame, ts: str = "ts", out: str = "is_peak") -> DataFrame:
    return df.withColumn(out, peak_hour(F.hour(ts)))


def select_features(df: DataFrame, features: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Keep the features and the target: all columns but time and identity, or the given list."""
    hidden = {TARGET, TIMESTAMP, "ts", "ts_raw", "file", "samples", *drop}
    names = list(features) if features else [c for c in df.columns if c not in hidden]
    return df.select(*names, TARGET)
