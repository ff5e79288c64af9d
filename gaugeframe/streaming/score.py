"""Scoring of arriving rows against the recent history of their series, kept as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LATE = "not later than the scored rows of its series"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups the series are dealt into. A call gets the new rows of a group; the state stays one entry per series.
GROUPS = 1024
# No underscore before them: the rows come as named tuples.
_GROUP, _NULLS = "series_group", "series_nulls"


def _plain(value):
    """A pandas cell as the value Spark holds; what is missing is None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def _cells(column: pd.Series) -> list:
    """All cells of a column, as :func:`_plain` gives them."""
    if column.dtype.kind in "biu":
        return column.tolist()
    return [None if v != v else v for v in column.tolist()] if column.dtype.kind == "f" else [_plain(v) for v in column]


def _same(value):
    """What tells series apart as Spark does: all NaN are one value, and so are both zeros."""
    if isinstance(value, float):
        return "NaN" if value != value else value + 0.0
    return value


class LastRows(StatefulProcessor):
    """The last rows of every series of a group; gives every later row the sequence that ends with it."""

    def __init__(self, keys: Sequence[str], order_by: Sequence[str], features: Sequence[str], seq_length: int, state: T.StructType, keep_ms: int | None):
        self.keys, self.order_by, self.features = list(keys), list(order_by), list(features)
        self.seq_length, self.state, self.keep_ms = seq_length, state, keep_ms
        self.names = [f.name for f in state.fields]
        self.series, self.ordered, self.inputs = ([self.names.index(c) for c in cs] for cs in (self.keys, self.order_by, self.features))

    def init(self, handle: StatefulProcessorHandle) -> None:
        series = T.StructType([self.state[k] for k in self.keys])
        rows = T.StructType([T.StructField("rows", T.ArrayType(self.state))])
        self.held = handle.getMapState("last_rows", series, rows, *([self.keep_ms] if self.keep_ms else []))

    def _place(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.ordered)

    def _by_series(self, chunks: Iterator[pd.DataFrame]) -> dict[tuple, tuple[tuple, list]]:
        """(key, rows) of every series that has new rows."""
        found: dict[tuple, tuple[tuple, list]] = {}
        for chunk in chunks:
            columns = [_cells(chunk[c]) for c in self.names]
            for i, nulls in enumerate(chunk[_NULLS]):
                row = tuple(c[i] for c in columns)
                if nulls:
                    row = tuple(None if nulls >> j & 1 else v for j, v in enumerate(row))
                # A key that is missing without being NULL is NaN.
                key = tuple(float("nan") if row[j] is None and not nulls >> j & 1 else row[j] for j in self.series)
                found.setdefault(tuple(map(_same, key)), (key, []))[1].append(row)
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for series, fresh in self._by_series(rows).values():
            fresh.sort(key=self._place)
            held = self.held.getValue(series)
            last = [tuple(row) for row in held[0]] if held else []
            newest = self._place(last[-1]) if last else None
            for row in fresh:
                late = newest is not None and self._place(row) <= newest
                sequence = None
                if not late:
                    last.append(row)
                    last = last[-self.seq_length :]
                    if len(last) == self.seq_length:
                        sequence = [[None if r[i] is None else float(r[i]) for i in self.inputs] for r in last]
                out.append((*row, sequence, LATE if late else None))
            # One row at least, so that later rows can be told from late ones.
            self.held.updateValue(series, (last[-max(self.seq_length - 1, 1) :],))
        yield pd.DataFrame(out, columns=[*self.names, "_X", "reason"], dtype=object)

    def close(self) -> None:
        pass


def sequences_of_stream(
    stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], features: Sequence[str], seq_length: int, keep_ms: int | None = None
) -> DataFrame:
    """Every arriving row with ``_X``, the sequence that ends with it, or with the ``reason`` why it is late.

    The state of a series is its last rows, and only series with new rows touch theirs. Rows of a batch are
    put in order; a row that is not later than those before it in earlier batches is late. ``_X`` is
    NULL for late rows and for those with too little history. With ``keep_ms`` the state of a
    series expires that long after its last row. Series are dealt into ``GROUPS`` groups, and a call gets
    all new rows of one: a call and an Arrow batch per series would cost more than the rows.
    """
    wanted = list(dict.fromkeys([*keys, *order_by, *features]))
    rows = stream.select(*wanted)
    out = T.StructType([*rows.schema.fields, T.StructField("_X", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("reason", T.StringType())])
    processor = LastRows(keys, order_by, features, seq_length, rows.schema, keep_ms)
    nulls = F.lit(0).cast("long")
    for i, name in enumerate(wanted):
        nulls = nulls + F.when(F.col(name).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    # Whole numbers with NULLs among them would come as fractions, which do not hold all of them.
    whole = {f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in rows.schema.fields if isinstance(f.dataType, T.IntegralType)}
    dealt = rows.withColumns({_GROUP: F.pmod(F.xxhash64(*keys), F.lit(GROUPS)), _NULLS: nulls}).withColumns(whole)
    return dealt.groupBy(_GROUP).transformWithStateInPandas(
        processor, outputStructType=out, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None"
    )


def stream_score(
    stream: DataFrame,
    path: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    features: Sequence[str],
    seq_length: int,
    score: Callable[[DataFrame], DataFrame],
    keep_ms: int | None = None,
) -> StreamingQuery:
    """Score every arriving row that has enough history; late rows are stored beside the scores.

    The sequences of a micro-batch are written once and then scored as a table. Output is written
    per batch number; a batch that is run again overwrites its own folders, which keeps
    each row scored once.
    """
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _KEYED_STORE)
    made = sequences_of_stream(stream, keys, order_by, features, seq_length, keep_ms)
    schema = made.schema

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/sequences/{batch_id}")
        rows = spark.read.schema(schema).parquet(f"{path}/sequences/{batch_id}")
        kept = list(dict.fromkeys([*keys, *order_by]))
        score(rows.where("_X is not null").select(*kept, F.col("_X").alias("X"))).write.mode("overwrite").parquet(f"{path}/scores/{batch_id}")
        rows.where("reason is not null").drop("_X").write.mode("overwrite").parquet(f"{path}/late/{batch_id}")

    return (
        made.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_late(spark, path: str) -> DataFrame:
    """Rows that came too late to be scored, with the reason."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/late")


def read_scores(spark, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/scores")
