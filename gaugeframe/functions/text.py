"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first substring found in the file name decides the type.
MODEL_TYPES = (
    ("linear", "Linear Regressor"),
    ("dnn", "Simple DNN"),
    ("lstm", "LSTM"),
    ("gru", "GRU"),
    ("transformer", "Transformer"),
)

# Suffixes of the per-window statistics, in matching order.
STAT_SUFFIXES = ("_mean", "_std", "_min", "_max")

LAG_MARK = "_t-"


def _ordered_case(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def classify_model(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return _ordered_case(
        [(F.contains(name, F.lit(part)), F.lit(label)) for part, label in MODEL_TYPES], F.lit("Unknown")
    )


def base_feature(name: Column) -> Column:
    """``jitter_mean_t-5`` gives ``jitter_mean``; a statistic suffix is dropped only from names without a lag."""
    stripped = _ordered_case(
        [(F.contains(name, F.lit(s)), F.replace(name, F.lit(s), F.lit(""))) for s in STAT_SUFFIXES], name
    )
    return F.when(F.contains(name, F.lit(LAG_MARK)), F.split_part(name, F.lit(LAG_MARK), F.lit(1))).otherwise(stripped)


def lag_step(name: Column) -> Column:
    """The lag of a feature name, NULL without one."""
    return F.when(
        F.contains(name, F.lit(LAG_MARK)), F.split_part(name, F.lit(LAG_MARK), F.lit(2)).try_cast("int")
    )


def stat_suffix(name: Column) -> Column:
    """The first statistic suffix a feature name contains, NULL without one."""
    return _ordered_case(
        [(F.contains(name, F.lit(s)), F.lit(s)) for s in STAT_SUFFIXES], F.lit(None).cast("string")
    )


def null_literal(col: Column) -> Column:
    """The text ``null`` and blanks as NULL."""
    return F.when(~F.trim(col).isin("null", ""), col)


def short_label(text: Column, width: int = 10) -> Column:
    """Text cut to ``width`` characters with dots, for axis labels."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
