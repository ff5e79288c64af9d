"""Tables behind the error plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.metrics import regression_metrics
from gaugeframe.operators.ranking import melt_metrics
from gaugeframe.plans.joins import match
from gaugeframe.session import materialize


def error_histogram(errors: DataFrame, bins: int = 30, groups: Sequence[str] = ("model",), error: str = "error") -> DataFrame:
    """Counts in equal-width bins between the smallest and largest error, empty bins included.

    The last bin holds its upper edge. A group with one distinct error gets a width of one.
    """
    groups = list(groups)
    ends = errors.groupBy(*groups).agg(F.min(error).alias("_lo"), F.max(error).alias("_hi"))
    level = F.col("_lo") == F.col("_hi")
    ends = ends.where(F.col("_lo").isNotNull()).select(
        *groups,
        F.when(level, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_from"),
        F.when(level, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_to"),
    )
    place = F.floor((F.col(error) - F.col("_from")) / (F.col("_to") - F.col("_from")) * float(bins))
    ends = materialize(ends, "histogram")
    counts = (
        match(errors.where(F.col(error).isNotNull()).select(*groups, error), ends, groups, ["_from", "_to"])
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy(*groups, "bin")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    width = (F.col("_to") - F.col("_from")) / float(bins)
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return match(frame, counts, [*groups, "bin"], ["_rows"], "left").select(
        *groups,
        "bin",
        (F.col("_from") + F.col("bin") * width).alias("bin_start"),
        (F.col("_from") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("_rows", F.lit(0)).alias("n_errors"),
    )


#: Terms of the expansion, the width of its cells and how far a cell is felt, both in units of sqrt(2) bandwidths.
TERMS, CELL, FELT = 16, 0.5, 6.5


def error_density(
    errors: DataFrame, points: int = 200, cut: float = 0.0, groups: Sequence[str] = ("model",), error: str = "error"
) -> DataFrame:
    """Gaussian kernel density of the errors on an even grid, Scott bandwidth.

    ``cut`` extends the grid by that many bandwidths. A fast Gauss transform: an error adds its first
    ``TERMS`` powers to the cell it lies in, whatever the number of points, and points read the cells they feel. Per error,
    the sum of kernels is off by less than 1e-13 from the cut of the expansion
    (1.09 * (CELL / 2 * sqrt 2)^16 / sqrt(16!)) and 1e-18 from cells that are not felt.
    """
    groups = list(groups)
    shape = errors.groupBy(*groups).agg(
        F.count(error).alias("_n"), F.stddev_samp(error).alias("_sd"), F.min(error).alias("_lo"), F.max(error).alias("_hi")
    )
    shape = shape.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).where(F.col("_h") > 0)
    shape = shape.select(
        *groups,
        "_n",
        "_h",
        "_lo",
        (F.col("_lo") - F.col("_h") * cut).alias("_from"),
        ((F.col("_hi") - F.col("_lo") + F.col("_h") * (2.0 * cut)) / float(points - 1)).alias("_step"),
    )
    shape = materialize(shape, "density")
    unit = F.col("_h") * math.sqrt(2.0)
    placed = match(errors.where(F.col(error).isNotNull()).select(*groups, error), shape, groups, ["_h", "_lo"])
    placed = placed.withColumn("_at", (F.col(error) - F.col("_lo")) / unit).withColumn("_cell", F.floor(F.col("_at") / CELL))
    placed = placed.withColumn("_z", F.col("_at") - (F.col("_cell") + 0.5) * CELL)
    power, powers = F.lit(1.0), []
    for k in range(TERMS):
        powers.append((F.sum(power) / float(math.factorial(k))).alias(f"_m{k}"))
        power = power * F.col("_z")
    cells = placed.groupBy(*groups, "_cell").agg(*powers)
    # The points a cell is felt at, by arithmetic; a cell may lie off every point.
    cells = match(cells, shape, groups, ["_h", "_lo", "_from", "_step"])
    centre = F.col("_lo") + (F.col("_cell") + 0.5) * CELL * unit
    first = F.greatest(F.ceil((centre - unit * FELT - F.col("_from")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((centre + unit * FELT - F.col("_from")) / F.col("_step")), F.lit(points - 1))
    felt = cells.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    felt = felt.withColumn("_t", (F.col("_from") + F.col("point") * F.col("_step") - centre) / unit)
    # Hermite functions by their recurrence; each term is a column, read by the next two.
    felt = felt.withColumns({"_f0": F.exp(-F.col("_t") * F.col("_t")), "_f1": 2 * F.col("_t") * F.exp(-F.col("_t") * F.col("_t"))})
    value = F.col("_m0") * F.col("_f0") + F.col("_m1") * F.col("_f1")
    for k in range(2, TERMS):
        felt = felt.withColumn(f"_f{k}", 2 * F.col("_t") * F.col(f"_f{k - 1}") - 2.0 * (k - 1) * F.col(f"_f{k - 2}"))
        value = value + F.col(f"_m{k}") * F.col(f"_f{k}")
    sums = felt.groupBy(*groups, "point").agg(F.sum(value).alias("_sum"))
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    return match(grid, sums, [*groups, "point"], ["_sum"], "left").select(
        *groups,
        F.col("point").cast("int").alias("point"),
        (F.col("_from") + F.col("point") * F.col("_step")).alias("x"),
        (F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2.0 * math.pi))).alias("density"),
    )


def model_comparison(predictions: DataFrame) -> DataFrame:
    """(model, metric, value) of the compared metrics."""
    table = regression_metrics(predictions, median=False)
    return melt_metrics(table, ["model"], ["mae", "rmse", "r2", "mean_error"])
