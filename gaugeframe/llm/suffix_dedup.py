"""Exact substring removal with suffix arrays by linear grouping (operator 5).

Every byte of a string of ``window`` bytes that also starts earlier goes. Winnowed anchors
(byte k-grams, one at least in any window) bring equal strings together; copies whose whole
context around an anchor is equal are aggregated first. The different contexts of an anchor,
cut to what they may share, are then laid end to end, a few groups at a time, and their suffixes sorted by grouping
(``grouping.suffix_array``); windows that are equal stand next to each other in that order, and
all but the earliest are removed. Anchors of more than ``TOGETHER`` contexts (a passage in a
great many different surroundings) first meet their earliest context, and only contexts that
leave it at the same place in the same way remain together, so that no task sorts a hot group.

To keep the sorted sequences short, the part of a context in which no window begins is written
in blocks of ``BLOCK`` bytes, ranked as bytes; all contexts of an anchor are aligned there, so
the order of the suffixes that begin before it is the same.

Nulls, empty texts: no bytes, nothing removed. Documents without an id neither lose bytes nor
take any. Rows that share a doc_id are one document apart from their text: of equal places the
row with the smaller text hash is earlier, and fully equal rows remove nothing from each
other. Texts of any length are read whole. Of extra columns only the key is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.anchors import byte_sequences, compared_at_once, contexts, covered, extended, numbered, unsqueezed, with_spans
from gaugeframe.llm.data import read
from gaugeframe.llm.grouping import suffix_array

WINDOW = 100
GRAM = 24
ORDER = ("doc", "pos", "u")
TOGETHER = 64
SORTED_CONTEXTS = 64
BLOCK = 64
# Contexts of groups up to this size are cut to what they may share before they are sorted.
PAIRED = 2 * TOGETHER
# Bytes of an Arrow batch, which the JVM and Python hold several times.
BATCH_BYTES = 4 << 20


def repeated_windows(rows: list[tuple[int, tuple, int, bytes]], window: int) -> list[list[int]]:
    """Per context (key, place of its first byte, bytes before the anchor, bytes) the offsets of windows
    that an earlier place holds too, by one suffix array over all of them."""
    tail: dict[int, int] = {}  # bytes before the anchor in which no window of the key starts
    for key, _, left, data in rows:
        tail[key] = min(tail.get(key, left), left + window - len(data))
    symbols: list[bytes] = []
    owner: list[int] = []
    offset: list[int] = []
    for i, (key, _, left, data) in enumerate(rows):
        single, starts = left - tail[key], len(data) - window
        own = [data[j : j + 1] for j in range(single)]
        own += [data[j : j + BLOCK] for j in range(single, len(data), BLOCK)]
        own.append(b"")  # ends a context; smaller than any byte
        symbols += own
        owner += [i] * len(own)
        offset += [*range(starts + 1), *[-1] * (len(own) - starts - 1)]
    ranks = {symbol: rank for rank, symbol in enumerate(sorted(set(symbols)), start=1)}
    found: list[list[int]] = [[] for _ in rows]
    last, same = None, []

    def close() -> None:
        places = [((doc, start + j, u), i, j) for i, j in same for doc, start, u in [rows[i][1]]]
        earliest = min(places)[0]
        for place, i, j in places:
            if place != earliest:  # a context may stand here under two keys
                found[i].append(j)

    for at in suffix_array([*map(ranks.__getitem__, symbols), 0])[1:]:
        j = offset[at]
        if j >= 0:
            i = owner[at]
            content = rows[i][3][j : j + window]
            if content == last:
                same.append((i, j))
            else:
                if len(same) > 1:
                    close()
                last, same = content, [(i, j)]
    if len(same) > 1:
        close()
    return found


def agreement(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def agreements(sides: list[bytes]) -> np.ndarray:
    """Lengths of the common beginnings of all pairs."""
    lengths = np.array([len(side) for side in sides])
    width = int(lengths.max()) + 1
    table = np.frombuffer(b"".join(side.ljust(width, b"\0") for side in sides), dtype=np.uint8).reshape(-1, width)
    differ = table[:, None] != table[None]
    differ[:, :, -1] = True
    return np.minimum(differ.argmax(axis=2), np.minimum.outer(lengths, lengths))


def with_partner(rows: list[tuple], window: int) -> list[tuple]:
    """The contexts (key, ..., left, data) of one key less those that cannot share a window with any other,
    cut to the bytes that a window shared with any other may have.

    Equal windows hold the anchor at the same place, so both contexts agree around it that far. Very large groups stay whole.
    """
    if not 1 < len(rows) <= PAIRED:
        return rows if len(rows) > 1 else []
    lefts, rights = zip(*((data[:left][::-1], data[left:]) for *_, left, data in rows))
    if len(rows) == 2:
        before, after = agreement(*lefts), agreement(*rights)
        most = [(before, after) if before + after >= window else None] * 2
    else:
        before, after = agreements(lefts), agreements(rights)
        shared = before + after >= window
        np.fill_diagonal(shared, False)
        befores, afters = (np.where(shared, side, 0).max(axis=1).tolist() for side in (before, after))
        most = [(x, y) if any_ else None for x, y, any_ in zip(befores, afters, shared.any(axis=1).tolist())]
    return [(*row[:-2], reach[0], row[-1][row[-2] - reach[0] : row[-2] + reach[1]]) for row, reach in zip(rows, most) if reach]


def sorted_spans(group: DataFrame, window: int) -> DataFrame:
    """Spans (doc, u, start, end) from suffix arrays over the contexts of each key."""

    def run(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        found = repeated_windows([(key, (doc, pos - left, u), left, data) for key, doc, u, pos, left, data in rows], window)
        spans = []
        for (_, doc, u, pos, left, _), offsets in zip(rows, found):
            start = end = None
            for j in sorted(offsets):
                if end is not None and j <= end - window + 1:
                    end = j + window
                else:
                    if end is not None:
                        spans.append((doc, u, pos - left + start, pos - left + end))
                    start, end = j, j + window
            if end is not None:
                spans.append((doc, u, pos - left + start, pos - left + end))
        return spans

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], []
        for batch in batches:
            spans = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if group and row[0] != group[-1][0]:
                    held += with_partner(group, window)
                    group = []
                    if len(held) >= SORTED_CONTEXTS:
                        spans += run(held)
                        held = []
                group.append(row)
            yield table(spans)
        yield table(run(held + with_partner(group, window)))

    def table(spans: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*spans)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["doc", "u", "start", "end"])

    dealt = group.select("key", "doc", "u", "pos", "left", "data").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(sort, "doc long, u long, start int, end int")


def repeated_strings(docs: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Byte spans (doc, u, start, end) of windows that start earlier too; ``docs``: doc, u, t."""
    split = compared_at_once(docs, byte_sequences, k, window)
    spans, rest = split.whole, contexts(docs, split.open, 1, bytes)
    while True:
        spans = spans.union(sorted_spans(rest.where(F.col("n") <= TOGETHER), window))
        hot = rest.where(F.col("n") > TOGETHER)
        if hot.isEmpty():
            return spans
        more, rest = extended(hot, ORDER, 1, window)
        spans = spans.union(more)


def kept_bytes(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, maximal removed runs, and the kept bytes."""
    if not starts:
        return len(text), 0, 0, text
    gone = covered(len(text), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))
    runs = int((gone & ~np.append(False, gone[:-1])).sum())
    return len(text), int(gone.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): every document without repeated strings."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    source = numbered(docs, key, text)
    held = with_spans(source, repeated_strings(source, window))

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def clean(z: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        cells = [kept_bytes(t, a, b) for t, a, b in zip(unsqueezed(z), starts.to_pylist(), ends.to_pylist())]
        columns = list(zip(*cells)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["n_bytes", "n_removed", "n_spans", "kept"])

    done = held.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), clean("z", "starts", "ends").alias("_c"))
    return done.select(key, "_c.n_bytes", "_c.n_removed", "_c.n_spans", "_c.kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": (op5_suffix_dedup, None)}
