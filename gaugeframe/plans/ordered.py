"""Row order without a single-task window.

``Window.orderBy(ts)`` without a partition key moves the whole series into one task, and a
series key does not help when one key holds a third of all rows. Both are avoided here:

* :func:`dense_index` range-partitions by the order key and adds to each row's position
  inside its partition the number of rows in the partitions before it.
* :func:`with_blocks` cuts that order into blocks of fixed size and copies the last rows of
  every block into the next one, so row-framed windows can run per block.
* :func:`series_position` numbers the rows of every series, joining series to rows per
  block so no join key ever has more than one block of rows.
* :func:`running_total` sums along the order of each group, however large the group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.plans.joins import match
from gaugeframe.session import materialize

BLOCK_ROWS = 8192
OWN_BLOCK = "_own_blk"
BLOCK = "_blk"
_SLOT = "_slot"
_PART = "_part_id"


def range_ordered(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions of the order, stored, with the place of each row in ``_slot``: its
    partition above the lowest 33 bits, its position inside in them.
    """
    cols = [F.col(c) for c in order_by]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return materialize(ranged.sortWithinPartitions(*cols).withColumn(_SLOT, F.monotonically_increasing_id()), "order")


def latest_before(
    df: DataFrame, order_by: Sequence[str], value: Column, rows: int, out: str, partitions: int | None = None
) -> DataFrame:
    """Add ``out``: the last ``rows`` non-null values of ``value`` before each row in the order, oldest first.

    NULL where there are fewer. A prefix scan over one stored range order: every partition hands its
    last values to the partitions after it, and rows read them there. Values are looked up by
    position inside a partition, so any number of rows may share the same last values, and no value is
    moved that does not end a partition.
    """
    if rows < 1:
        raise ValueError("at least one value")
    stored = range_ordered(df.withColumn("_value", value), order_by, partitions)
    stored = stored.withColumn(_PART, F.shiftright(_SLOT, 33))

    def looked_back(window: str) -> Column:
        """The last values before a row, the nearest first; NULL at those that do not exist."""
        return F.array(*[F.expr(f"lag(_value, {k}) IGNORE NULLS OVER ({window})") for k in range(1, rows + 1)])

    # The values that end a partition, and a mark per partition that reads those before it.
    newest = Window.partitionBy(_PART).orderBy(F.desc(_SLOT))
    ends = stored.where("_value is not null").select(_PART, _SLOT, "_value", F.row_number().over(newest).alias("_nth")).where(F.col("_nth") <= rows)
    marks = stored.groupBy(_PART).agg(F.lit(-1).cast("long").alias(_SLOT)).withColumn("_value", F.lit(None).cast(stored.schema["_value"].dataType))
    handed = ends.drop("_nth").unionByName(marks).withColumn("_before", looked_back(f"ORDER BY {_PART}, {_SLOT}")).where(f"{_SLOT} = -1")
    handed = handed.select(_PART, F.posexplode("_before").alias("_k", "_value")).where("_value is not null")
    names = [c for c in stored.columns if c not in (_PART, _SLOT, "_value")]
    carried = handed.select(_PART, (-1 - F.col("_k")).cast("long").alias(_SLOT), "_value", F.lit(None).cast(stored.select(F.struct(*names)).schema[0].dataType).alias("_row"))
    own = stored.select(_PART, _SLOT, "_value", F.struct(*names).alias("_row"))
    found = own.unionByName(carried).withColumn("_found", looked_back(f"PARTITION BY {_PART} ORDER BY {_SLOT}")).where(f"{_SLOT} >= 0")
    known = F.when(F.get("_found", F.lit(rows - 1)).isNotNull(), F.reverse("_found"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in names], known.alias(out))


def dense_index(
    df: DataFrame, order_by: Sequence[str], idx: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Add ``idx`` = 0..n-1 in the order of ``order_by``, which must identify a row.

    One range shuffle. The sorted rows are written once to the shared folder, because the
    partition sizes and the rows must come from the same partitioning. The sizes are one
    row per partition, which bounds the broadcast.
    """
    stored = range_ordered(df, order_by, partitions)
    part = F.shiftright(_SLOT, 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(offsets), part == F.col("_part")).select(
        *df.columns, (F.col("_offset") + position).alias(idx)
    )


def row_total(indexed: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return indexed.agg(F.count(F.lit(1))).scalar()


def block_of(idx: str, block_rows: int) -> Column:
    return F.expr(f"`{idx}` div {block_rows}")


def with_blocks(
    indexed: DataFrame, history: int, idx: str = "idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the block of each row, repeating the last ``history`` rows of a block in the next one.

    Repeated rows have ``_blk <> _own_blk``; drop them after the window with :func:`owned`.
    """
    if history > block_rows:
        raise ValueError("a block must hold at least the rows one frame looks back on")
    own = block_of(idx, block_rows)
    in_tail = F.pmod(F.col(idx), F.lit(block_rows)) >= block_rows - history
    return indexed.withColumn(OWN_BLOCK, own).withColumn(
        BLOCK,
        F.explode(
            F.when(in_tail, F.array(F.col(OWN_BLOCK), F.col(OWN_BLOCK) + 1)).otherwise(F.array(F.col(OWN_BLOCK)))
        ),
    )


def owned() -> Column:
    return F.col(BLOCK) == F.col(OWN_BLOCK)


def block_window(keys: Sequence[str] = (), idx: str = "idx"):
    return Window.partitionBy(BLOCK, *keys).orderBy(idx)


def series_position(
    indexed: DataFrame,
    keys: Sequence[str],
    position: str = "pos",
    total: str = "n_rows",
    idx: str = "idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the rows of each series 0..n-1 and add the series length.

    ``indexed`` must be ordered by ``keys`` first, so a series is a run of ``idx``.
    """
    runs = indexed.groupBy(*keys).agg(F.min(idx).alias("_first"), F.count(F.lit(1)).alias(total))
    first_block = F.expr(f"_first div {block_rows}")
    last_block = F.expr(f"(_first + `{total}` - 1) div {block_rows}")
    runs = runs.withColumn(BLOCK, F.explode(F.sequence(first_block, last_block)))
    placed = match(indexed.withColumn(BLOCK, block_of(idx, block_rows)), runs, [*keys, BLOCK], ["_first", total])
    return placed.select(*indexed.columns, (F.col(idx) - F.col("_first")).alias(position), total)


def running_total(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], weight: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` within ``keys``, in the order of ``order_by``.

    Groups are cut at the range partitions: sums run inside a partition and start from the
    total of the group's earlier partitions. Keys and order together must identify a row.
    """
    cols = [F.col(c) for c in (*keys, *order_by)]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    stored = materialize(
        ranged.sortWithinPartitions(*cols).withColumn(_PART, F.spark_partition_id()), "running"
    )
    sums = stored.groupBy(_PART, *keys).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_k_{c}") for c in (_PART, *keys)], "_start")
    inside = stored.withColumn(out, F.sum(weight).over(Window.partitionBy(_PART, *keys).orderBy(*order_by)))
    condition = F.col(_PART) == F.col(f"_k_{_PART}")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return inside.join(starts, condition).select(*df.columns, (F.col(out) + F.col("_start")).alias(out))
