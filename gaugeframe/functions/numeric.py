"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_double(col: Column) -> Column:
    """DOUBLE, or NULL where the text does not parse; NaN counts as missing."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def exact_round(x: Column, digits: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    ``round`` and ``bround`` decide on the shortest decimal text of the number, so they
    differ from binary rounding near ties (2.675 is stored below the tie). Here the
    distance to the tie is computed without error: ``x`` is split into two halves whose
    products with the scale are exact. Meant for |x| below 2**40 and up to 6 digits.
    """
    scale = float(2 * 10**digits)
    wide = x * F.lit(134217729.0)  # 2**27 + 1
    high = wide - (wide - x)
    low = x - high
    halves = F.rint(x * F.lit(scale))
    above = (high * F.lit(scale) - halves) + low * F.lit(scale)
    odd = F.abs(halves % F.lit(2.0)) == 1.0
    units = (
        F.when(odd & (above > 0), (halves + 1.0) / 2.0)
        .when(odd & (above < 0), (halves - 1.0) / 2.0)
        .otherwise(F.rint(halves / 2.0))
    )
    return units / F.lit(float(10**digits))


def clip_round(x: Column, low: float = 0.0, high: float = 100.0, digits: int = 6) -> Column:
    """Clip to [low, high], then round."""
    return exact_round(F.greatest(F.lit(low), F.least(x, F.lit(high))), digits)


def coefficient_of_variation(std: Column, mean: Column) -> Column:
    """std / mean; NULL for a zero mean."""
    return F.when(mean != 0, std / mean)


def squared_error(truth: Column, prediction: Column) -> Column:
    return (prediction - truth) * (prediction - truth)


def log_cosh(error: Column) -> Column:
    """log(cosh(error)) in the form that does not overflow."""
    size = F.abs(error)
    return size + F.log1p(F.exp(size * -2.0)) - F.ln(F.lit(2.0))


def qoe_formula(
    packet_loss_rate: Column,
    jitter: Column,
    throughput: Column,
    speed: Column,
    peak: Column,
    noise: Column | None = None,
) -> Column:
    """The 0..100 quality score of one measurement."""
    # Weights of the score.
    raw = (
        F.lit(95.0)
        - packet_loss_rate * 4.0
        - jitter * 0.1
        + ((throughput - 600.0) / 1000.0) * 5.0
        - speed * 0.05
        - F.when(peak, F.lit(5.0)).otherwise(F.lit(0.0))
    )
    return clip_round(raw if noise is None else raw + noise)


def r2_score(n: Column, sse: Column, truth_var: Column, truth_min: Column, truth_max: Column) -> Column:
    """1 - SSE/SST. A constant truth scores 1 when met exactly and 0 otherwise; one row has no score."""
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(truth_min == truth_max, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1.0 - sse / (n * truth_var))
    )
