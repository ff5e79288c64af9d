"""Sliding sequences over a distributed order (see ``plans.ordered``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.plans.ordered import BLOCK_ROWS, block_window, latest_before, owned, with_blocks
from gaugeframe.schemas import TARGET


def _sequences(
    indexed: DataFrame,
    length: int,
    features: Sequence[str],
    carry: Sequence[str],
    keys: Sequence[str],
    idx: str,
    block_rows: int,
    first: int,
    last: int,
) -> DataFrame:
    wanted = list(dict.fromkeys([*keys, idx, *carry, *features]))
    frame = block_window(keys, idx).rowsBetween(first, last)
    # The array around the features keeps rows with NULL features in the list.
    return (
        with_blocks(indexed.select(*wanted), length, idx, block_rows)
        .withColumn("_X", F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(frame))
        .where(owned() & (F.size("_X") == length))
    )


def make_sequences(
    indexed: DataFrame,
    seq_length: int,
    features: Sequence[str],
    target: str = TARGET,
    carry: Sequence[str] = (),
    keys: Sequence[str] = (),
    idx: str = "idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """X = the ``seq_length`` rows before a row, y = the target of the row itself.

    With ``keys`` the rows of a sequence all belong to one series; ``indexed`` must then be
    ordered by the keys first. ``seq`` is the index of the first row of X.
    """
    found = _sequences(
        indexed, seq_length, features, [*carry, target], keys, idx, block_rows, -seq_length, -1
    )
    out = list(dict.fromkeys([*keys, *carry]))
    return found.select(
        *out, (F.col(idx) - seq_length).alias("seq"), F.col("_X").alias("X"), F.col(target).cast("double").alias("y")
    )


def make_trailing_sequences(
    indexed: DataFrame,
    seq_length: int,
    features: Sequence[str],
    carry: Sequence[str] = (),
    keys: Sequence[str] = (),
    idx: str = "idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """X = the ``seq_length`` rows ending with the row itself; rows with less history give none."""
    found = _sequences(
        indexed, seq_length, features, carry, keys, idx, block_rows, -(seq_length - 1), 0
    )
    return found.select(*dict.fromkeys([*keys, *carry, idx]), F.col("_X").alias("X"))


def history_tail(df: DataFrame, rows: int, order_by: Sequence[str]) -> DataFrame:
    """The last ``rows`` rows, as context for a record to score."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(rows)


def fallback_sequences(
    metadata: DataFrame, df: DataFrame, seq_length: int, features: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Give every file the last ``seq_length`` rows. Opt-in, for when no file matches a row."""
    tail = history_tail(df, seq_length, order_by).select(
        F.struct(*order_by).alias("at"), F.array(*[F.col(f).cast("double") for f in features]).alias("row")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda r: r["row"])
    last = tail.agg(F.when(F.count(F.lit(1)) == seq_length, ordered).alias("X")).scalar()
    return metadata.withColumn("X", last).where(F.col("X").isNotNull())


def flatten_sequence(sequences: DataFrame, x: str = "X", out: str = "flat") -> DataFrame:
    """S x F to one array, oldest step first."""
    return sequences.withColumn(out, F.flatten(x))


def feature_step_names(features: Sequence[str], seq_length: int) -> list[str]:
    """Names of the flattened columns; step ``seq_length`` is the oldest."""
    return [f"{name}_t-{seq_length - step}" for step in range(seq_length) for name in features]


def mean_pool(sequences: DataFrame, width: int, x: str = "X", out: str = "pooled") -> DataFrame:
    """Average over the time steps, one value per feature; a step of another width is an error."""
    fits = F.forall(x, lambda row: F.size(row) == width)
    checked = F.when(fits, F.col(x)).otherwise(F.raise_error(F.lit(f"the steps do not have {width} features")))
    total = F.aggregate(
        checked,
        F.array(*[F.lit(0.0)] * width),
        lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b),
    )
    return sequences.withColumn(out, F.transform(total, lambda v: v / F.size(x)))


def asof_history(
    new: DataFrame,
    history: DataFrame,
    seq_length: int,
    features: Sequence[str],
    key: str,
    ts: str = "ts",
    partitions: int | None = None,
    keep_short: bool = False,
) -> DataFrame:
    """Sequence of every new record: the ``seq_length`` - 1 last history rows before it, then itself.

    ``key`` identifies a record on either side; a history row of the same time is not before. One
    stored order of both sides together and a prefix scan over it (``plans.ordered.latest_before``); a sequence is
    made for new records only. Records with too little history give none, or with
    ``keep_short`` a NULL one.
    """
    own = F.array(*[F.col(f).cast("double") for f in features])
    if seq_length == 1:
        return new.withColumn("X", F.array(own))
    sides = history.select(ts, key, own.alias("_own"), F.lit(1).alias("_side"), F.lit(None).cast(new.select(F.struct("*")).schema[0].dataType).alias("_new"))
    sides = sides.unionByName(new.select(ts, key, own.alias("_own"), F.lit(0).alias("_side"), F.struct("*").alias("_new")))
    placed = latest_before(sides, [ts, "_side", key], F.when(F.col("_side") == 1, F.col("_own")), seq_length - 1, "_past", partitions)
    found = placed.where(F.col("_side") == 0)
    if not keep_short:
        found = found.where(F.col("_past").isNotNull())
    return found.select(*[F.col("_new").getField(c).alias(c) for c in new.columns], F.concat("_past", F.array("_own")).alias("X"))


def last_in_series(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], rows: int) -> DataFrame:
    """The last ``rows`` rows of each series; pruned per partition before the shuffle."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= rows).drop("_rn")
