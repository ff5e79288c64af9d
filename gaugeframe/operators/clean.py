"""Typing, validity, masking and repair of windows and records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.numeric import try_double
from gaugeframe.functions.text import null_literal
from gaugeframe.functions.timeparse import parse_ts
from gaugeframe.schemas import META_KEYS, METRICS, TARGET, TIMESTAMP

# A quoted whole number as the value of "speed"; the groups are the colon, the sign and the digits.
_QUOTED_SPEED = r'"speed"(\s*:\s*)"\s*\+?(-?)0*(\d+)\s*"'
_TEXT_SPEED = r'"speed"\s*:\s*"'


def coerce_numeric(df: DataFrame, keep: Sequence[str] = (TIMESTAMP, "file", "ts")) -> DataFrame:
    """All columns but ``keep`` to DOUBLE; values that do not parse become NULL."""
    return df.select(*[c if c in keep else try_double(F.col(c)).alias(c) for c in df.columns])


def with_parsed_ts(df: DataFrame, column: str = TIMESTAMP, out: str = "ts") -> DataFrame:
    return df.withColumn(out, parse_ts(F.col(column)))


def is_valid_window(doc: Column, layout: str = "new") -> Column:
    """Has a non-null QoE, a timestamp and, in the new layout, a first sub-sample with all fields.

    Only the first sub-sample in document order is looked at. The one-element arrays bind a
    parsed map to a name, so that it is not parsed again for every condition.
    """

    def has(m: Column, key: str) -> Column:
        return F.map_contains_key(m, F.lit(key))

    def first_complete(d: Column) -> Column:
        keys = F.filter(F.map_keys(d), lambda k: ~k.isin(*META_KEYS))
        first = F.from_json(F.try_element_at(d, F.get(keys, F.lit(0))), "map<string,string>")
        return F.exists(F.array(first), lambda f: reduce(lambda a, b: a & b, [has(f, m) for m in METRICS["new"]]))

    def conditions(d: Column) -> Column:
        head = has(d, TARGET) & has(d, TIMESTAMP) & F.try_element_at(d, F.lit(TARGET)).isNotNull()
        return head if layout == "legacy" else head & first_complete(d)

    return F.coalesce(F.exists(F.array(doc), conditions), F.lit(False))


def valid_window(docs: DataFrame, layout: str = "new", doc: str = "doc") -> DataFrame:
    return docs.where(is_valid_window(F.col(doc), layout))


def validity_counts(docs: DataFrame, layout: str = "new", doc: str = "doc") -> DataFrame:
    flagged = docs.select(is_valid_window(F.col(doc), layout).alias("ok"))
    return flagged.agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"))


def mask_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Hide the target and keep it as ``<target>_truth``."""
    return df.withColumn(f"{target}_truth", F.col(target)).withColumn(target, F.lit(None).cast("double"))


def repair_types(docs: DataFrame, value: str = "value") -> DataFrame:
    """Unquote whole-number ``speed`` values.

    Adds ``modified`` and ``unparsable`` (quoted speeds left as they are). Documents that
    are not JSON stay unchanged.
    """
    broken = F.from_json(value, "map<string,string>").isNull()
    fixed = F.when(broken, F.col(value)).otherwise(F.regexp_replace(value, _QUOTED_SPEED, '"speed"$1$2$3'))
    return (
        docs.withColumn("_fixed", fixed)
        .withColumn("modified", F.col("_fixed") != F.col(value))
        .withColumn("unparsable", F.regexp_count("_fixed", F.lit(_TEXT_SPEED)))
        .withColumn(value, F.col("_fixed"))
        .drop("_fixed")
    )


def repair_counts(repaired: DataFrame) -> DataFrame:
    return repaired.agg(
        F.count(F.lit(1)).alias("n_processed"),
        F.count_if("modified").alias("n_modified"),
        F.coalesce(F.sum("unparsable"), F.lit(0)).alias("n_unparsable"),
    )


def null_literal_clean(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The text ``null`` to NULL, metrics to numbers, rows with any NULL dropped."""
    typed = df.select(
        *[
            (try_double(F.col(c)) if c in metrics else null_literal(F.col(c))).alias(c)
            for c in df.columns
        ]
    )
    return typed.na.drop()
