"""Exact order statistics that never gather a group in one task.

A sketch with a bound on the rank of what it returns gives two values around each wanted rank. Between them
the distinct values are kept, everything else is only counted, both in one pass; the wanted
value is found by its rank among the counts. The sketch decides how few values are kept, never
which one is returned, and it is an error if the wanted rank is not among them.

The input is read twice, for the sketch and for the counts. Sums of the first pass come along
with it. The kept values are ordered across tasks, however many or few they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.plans.joins import match
from gaugeframe.plans.ordered import running_total
from gaugeframe.session import materialize

ACCURACY = 10000


def select_ranks(
    df: DataFrame,
    value: str,
    ranks: dict[str, tuple[float, Column]],
    groups: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """For every group and named rank: the value at that 0-based rank and the rows below it.

    ``ranks`` maps a name to (approximate fraction, rank as a column over ``_n``, the number
    of values of the group). Returns (groups, name, value, below, n); a rank outside 0.._n-1
    has no row.
    """
    base = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    return _ranked(base, _sketched(base, [p for p, _ in ranks.values()], groups, accuracy), ranks, groups)


#: Groups of fewer values are kept whole.
FEW = 200


def _fractions(wanted: Sequence[float]) -> list[float]:
    return sorted({min(max(p, 0.0), 1.0) for p in wanted})


def _sketched(base: DataFrame, fractions: Sequence[float], groups: Sequence[str], accuracy: int, extra: Sequence[Column] = ()) -> DataFrame:
    """One stored row per group: the count, two values around each fraction, and ``extra`` sums of the same pass.

    The values lie at least two ranks further off than the sketch may err: twice its error for large
    groups, more for those in which that is less than two ranks, and the ends for the smallest.
    """
    around = lambda slack: [min(max(p + d, 0.0), 1.0) for p in _fractions(fractions) for d in (-slack, slack)]
    near, wide = around(2.0 / accuracy), around(0.02 + 2.0 / accuracy)
    cuts = F.percentile_approx("_v", [*near, *wide, 0.0, 1.0], accuracy).alias("_all")
    sketch = base.groupBy(*groups).agg(F.count("_v").alias("_size"), cuts, *extra)
    n = len(near)
    ends = F.flatten(F.array_repeat(F.slice("_all", 2 * n + 1, 2), n // 2))
    chosen = F.when(F.col("_size") < FEW, ends).when(F.col("_size") < 2 * accuracy, F.slice("_all", n + 1, n)).otherwise(F.slice("_all", 1, n))
    return materialize(sketch.withColumn("_cuts", chosen).drop("_all"), "sketch")


def _ranked(base: DataFrame, sketch: DataFrame, ranks: dict[str, tuple[float, Column]], groups: Sequence[str]) -> DataFrame:
    groups = list(groups)
    pairs = len(_fractions([p for p, _ in ranks.values()]))
    if groups:
        placed = match(base, sketch, groups, ["_cuts"])
    else:
        placed = base.withColumn("_cuts", sketch.select("_cuts").scalar())
    interval, near = F.lit(0), F.lit(False)
    for i in range(pairs):
        low, high = F.col("_cuts")[2 * i], F.col("_cuts")[2 * i + 1]
        interval = interval + (F.col("_v") > low).cast("int") + (F.col("_v") > high).cast("int")
        near = near | ((F.col("_v") >= low) & (F.col("_v") <= high))
    placed = placed.select(*groups, "_v", F.when(near, F.col("_v")).alias("_kept"), F.when(~near, interval).alias("_iv"))
    # The counted stretches hold no kept value, so the smallest value of each puts all in order.
    counted = placed.groupBy(*groups, "_kept", "_iv").agg(F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_first"))
    placed = running_total(counted, groups, ["_first"], "_rows", "_upto")
    if groups:
        placed = match(placed, sketch.select(*groups, F.col("_size").alias("_n")), groups, ["_n"])
    else:
        placed = placed.withColumn("_n", sketch.select("_size").scalar())
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, (_, rank) in ranks.items()]
    )
    below = F.col("_upto") - F.col("_rows")
    hits = placed.withColumn("_below", below).withColumn(
        "_hit", F.explode(F.filter(wanted, lambda t: (t["rank"] >= F.col("_below")) & (t["rank"] < F.col("_upto"))))
    )
    found = F.when(F.col("_kept").isNotNull(), F.col("_kept")).otherwise(F.raise_error(F.lit("the sketch missed a rank; use a smaller accuracy")))
    return hits.select(
        *groups, F.col("_hit.name").alias("name"), found.alias("value"), F.col("_below").alias("below"), F.col("_n").alias("n")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
    accuracy: int = ACCURACY,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per group with a column per quantile, interpolated linearly between ranks.

    With ``extra``, named aggregates of ``df``, their columns follow, from the pass that
    makes the sketch; a group without a value then has a row too, with NULL quantiles.
    """
    groups = list(groups)
    ranks: dict[str, tuple[float, Column]] = {}
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        ranks[f"{name}:lo"] = (p, F.floor(at))
        ranks[f"{name}:hi"] = (p, F.ceil(at))
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    number = df.withColumn("_v", F.when(usable, F.col(value).cast("double")))
    base = number.where("_v is not null").select(*groups, "_v")
    sketch = _sketched(number if extra else base, list(probs.values()), groups, accuracy, extra)
    picked = _ranked(base, sketch, ranks, groups)
    joined = picked.groupBy(*groups).agg(
        F.max("n").alias("_m"),
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ranks],
    )
    out = []
    for name, p in probs.items():
        at = (F.col("_m") - 1) * F.lit(float(p))
        low, high = F.col(f"`{name}:lo`"), F.col(f"`{name}:hi`")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    quantiles = joined.select(*groups, *out)
    if not extra:
        return quantiles
    sums = sketch.drop("_size", "_cuts")
    if groups:
        return match(sums, quantiles, groups, list(probs), "left")
    row = quantiles.select(F.struct(*probs).alias("_q")).scalar()
    return sums.withColumn("_q", row).select(*sums.columns, *[F.col("_q").getField(name).alias(name) for name in probs])
