"""Time-ordered splits and exact sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.plans.quantiles import select_ranks
from gaugeframe.session import materialize

#: Hashes are below this; deviations of the expected place within which a sample's last hash is looked for.
HASHES, WIDTH = 1 << 60, 8.0


def total_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def split_point(total: Column, ratio: float) -> Column:
    return F.floor(total * F.lit(float(ratio)))


def split_sequential(
    df: DataFrame, ratio: float = 0.8, idx: str = "seq", total: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """First floor(n * ratio) rows and the rest, by a dense index.

    Pass ``total`` when the count is known more cheaply than by counting ``df``.
    """
    marked = df.withColumn("_cut", split_point(total_rows(df) if total is None else total, ratio))
    return (
        marked.where(F.col(idx) < F.col("_cut")).drop("_cut"),
        marked.where(F.col(idx) >= F.col("_cut")).drop("_cut"),
    )


def tail_test(df: DataFrame, ratio: float = 0.2, idx: str = "seq", total: Column | None = None) -> DataFrame:
    """The last floor(n * ratio) rows; none if that is zero."""
    n = total_rows(df) if total is None else total
    return (
        df.withColumn("_n", n).where(F.col(idx) >= F.col("_n") - split_point(F.col("_n"), ratio)).drop("_n")
    )


def validation_tail(
    df: DataFrame, train_ratio: float = 0.8, validation_ratio: float = 0.2, idx: str = "seq", total: Column | None = None
) -> DataFrame:
    """Label every row train, validation or test; validation is the end of the training part."""
    cut = split_point(total_rows(df) if total is None else total, train_ratio)
    return (
        df.withColumn("_cut", cut)
        .withColumn("_inner", split_point(F.col("_cut"), 1.0 - validation_ratio))
        .withColumn(
            "split",
            F.when(F.col(idx) < F.col("_inner"), "train").when(F.col(idx) < F.col("_cut"), "validation").otherwise("test"),
        )
        .drop("_cut", "_inner")
    )


def sample_hash(key: Column, seed: int) -> Column:
    """60 bits of an MD5 of key and seed; the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def _edge(hashes: DataFrame, n: int, k: int) -> tuple[int, int, int]:
    """(hash at rank k - 1, rows below it, rows with it).

    The hashes are uniform, so the wanted one lies within ``WIDTH`` deviations of its expected
    place but for one case in 10^15: one pass counts the rows below that stretch and keeps the few hashes in it,
    some 16 times the root of n. The sketch of ``plans.quantiles`` takes the remaining cases.
    """
    reach = WIDTH * math.sqrt(k * (1 - k / n) + 1) + WIDTH
    low, high = (int(min(max((k + side * reach) / n, 0.0), 1.0) * HASHES) for side in (-1, 1))
    place = F.when(F.col("_h") < low, -1).when(F.col("_h") > high, HASHES).otherwise(F.col("_h"))
    counted = materialize(hashes.groupBy(place.alias("_place")).agg(F.count(F.lit(1)).alias("_rows")), "edge")
    upto = F.sum("_rows").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counted.withColumn("_upto", upto).where(F.col("_upto") >= k).orderBy("_place").first()
    if 0 <= found["_place"] < HASHES:
        return found["_place"], found["_upto"] - found["_rows"], found["_rows"]
    ranked = select_ranks(hashes, "_h", {"edge": (k / n, F.lit(k - 1))}).first()
    return ranked["value"], ranked["below"], hashes.where(F.col("_h") == ranked["value"]).count()


def sample_exact(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Exactly floor(n * ratio) rows, repeatable by seed; all rows for a ratio of 1 or more.

    Keeps the rows up to the wanted order statistic of the hash instead of sorting and
    limiting, so the sample itself is a plain filter. ``key`` must identify a row and not
    be NULL; it breaks ties, which only rows with the same 60-bit hash can have.
    """
    if ratio >= 1.0:
        return df
    hashed = df.withColumn("_h", sample_hash(F.col(key), seed))
    n = df.count()
    k = math.floor(n * ratio)
    if k == 0:
        return df.limit(0)
    value, below, ties = _edge(hashed.select("_h"), n, k)
    kept = F.col("_h") <= value
    if below + ties > k:
        at_edge = hashed.where(F.col("_h") == value)
        last = at_edge.orderBy(key).limit(k - below).agg(F.max(key)).first()[0]
        kept = (F.col("_h") < value) | ((F.col("_h") == value) & (F.col(key) <= F.lit(last)))
    return hashed.where(kept).select(*df.columns)
