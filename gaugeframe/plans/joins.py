"""Joins in which a NULL key meets a NULL key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, names: Sequence[str], extra: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, NULLs alike, keeping the left columns and ``extra`` of the right."""
    right = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *extra)
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"_r_{name}"])
    return left.join(right, condition, how).select(*left.columns, *extra)
