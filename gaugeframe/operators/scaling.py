"""Min-max scaling with a fitted table (col, pos, min, max), target last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.schemas import TARGET


def fit_scaler(df: DataFrame, columns: Sequence[str], target: str | None = TARGET) -> DataFrame:
    """Bounds of every column in one aggregate."""
    names = [*columns, *([target] if target else [])]
    ends = df.agg(*[f(c).cast("double").alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("col"), F.lit(i).alias("pos"), F.col(f"lo_{i}").alias("min"), F.col(f"hi_{i}").alias("max")
            )
            for i, c in enumerate(names)
        ]
    )
    return ends.select(F.inline(rows))


def _bounds(scaler: DataFrame, names: Sequence[str]) -> Column:
    """The wanted bounds as one struct from a scalar subquery; no join. A missing column is an error."""
    picks = []
    for i, name in enumerate(names):
        absent = F.count_if(F.col("col") == name) == 0
        message = F.raise_error(F.lit(f"the scaler has no column {name}")).cast("double")
        picks += [F.when(absent, message).otherwise(F.max(F.when(F.col("col") == name, F.col(k)))).alias(f"{k}_{i}") for k in ("min", "max")]
    return scaler.agg(F.struct(*picks).alias("bounds")).scalar()


def _width(low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise(high - low)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column only loses its offset. NULL stays NULL."""
    with_bounds = df.withColumn("_bounds", _bounds(scaler, columns))
    scaled = {}
    for i, name in enumerate(columns):
        low, high = F.col("_bounds")[f"min_{i}"], F.col("_bounds")[f"max_{i}"]
        scaled[name] = (F.col(name) - low) / _width(low, high)
    return with_bounds.select(*[scaled[c].alias(c) if c in scaled else c for c in df.columns])


def inverse_scale(
    df: DataFrame, scaler: DataFrame, columns: Sequence[str], target: str = TARGET
) -> DataFrame:
    """Map scaled predictions back; only the bounds of the target matter."""
    with_bounds = df.withColumn("_bounds", _bounds(scaler, [target]))
    low, high = F.col("_bounds")["min_0"], F.col("_bounds")["max_0"]
    return with_bounds.select(
        *[(F.col(c) * _width(low, high) + low).alias(c) if c in columns else c for c in df.columns]
    )
