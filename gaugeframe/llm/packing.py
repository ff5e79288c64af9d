"""Sequence packing by shortest-pack-first over the length histogram (operator 1).

Documents become token ids and are cut into pieces of at most ``capacity`` ids. Only the
histogram of piece lengths (at most ``capacity`` rows, whatever the data) reaches the driver.
There, lengths are placed longest first, each into the pattern whose packs are shortest so
far, on counts instead of documents. Pieces are then ranked within their length across tasks
and matched to the slots of the patterns by rank.

Nulls and empty texts: the document is its end-of-text id alone. Rows that are repeated are
packed each. A null id keeps its row. Extra columns are carried by ``pack``; one that bears the
name of an output column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.data import read
from gaugeframe.llm.splitting import AGREED, SPLIT, specials
from gaugeframe.session import materialize

CAPACITY = 2048
END_ID = 1
# Rows of one length that are ranked together, about; a frequent length is dealt to many groups.
RANKED_ROWS = 1_000
BATCH_CHARS = 1 << 20


@functools.cache
def _fast(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, path: str, ranks_path: str | None) -> np.ndarray:
    """The ids the tokenizers library gives for a text.

    With ``ranks_path`` (the same vocabulary as ranks) texts on which both libraries split
    alike and that hold no special string take the quicker encoder.
    """
    special = specials(path)
    if ranks_path and AGREED.search(text) is None and not (special and special.search(text)):
        return np.asarray(_fast(ranks_path).encode_ordinary(text), dtype="<u4")
    return np.asarray(_library(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ranks_path: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens and, on request, its ids.

    Documents are cut at multiples of ``capacity``.
    """
    if path is None:
        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    source = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    key_type = source.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, held = [[] for _ in range(6)], 0
            for name, value in zip(batch.column(0), batch.column(1)):
                ids = np.append(token_ids(value.as_py() or "", path, ranks_path), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row = (name, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece)
                    for column, cell in zip(columns, row):
                        column.append(cell)
                held += len(ids)
                if held >= BATCH_CHARS:
                    yield packed(batch, columns)
                    columns, held = [[] for _ in range(6)], 0
            if columns[0]:
                yield packed(batch, columns)

    def packed(batch: pa.RecordBatch, columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array([k.as_py() for k in columns[0]], type=batch.column(0).type)]
        arrays += [pa.array(c, type=pa.int64()) for c in columns[1:5]]
        names = [key, "start", "length", "ids_crc32", "doc_tokens"]
        if keep_ids:
            flat = np.concatenate(columns[5]).astype(np.int32)
            bounds = np.cumsum([0, *map(len, columns[5])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(cut, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths) per pattern; every length of the histogram is used up.

    Longest first, each length goes to the packs that are shortest so far, if it fits there,
    else to new packs, which take it as often as it fits. A pattern is split when only part of its packs take the length.
    """
    space: dict[int, list[tuple[int, list[int]]]] = {}
    spaces: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if spaces and spaces[-1] >= length:
                room = spaces[-1]
                packs, pattern = space[room].pop()
                used = min(left, packs)
                if packs > used:
                    space[room].append((packs - used, pattern))
                elif not space[room]:
                    spaces.pop()
                    del space[room]
                pattern = [*pattern, length]
            else:
                # A new pack is the only one with room, so it takes this length until it is full.
                each = min(capacity // length, left)
                used, pattern, room = left // each, [length] * each, capacity - length * (each - 1)
                left -= used * (each - 1)
            if room - length not in space:
                space[room - length] = []
                insort(spaces, room - length)
            space[room - length].append((used, pattern))
            left -= used
    return [entry for entries in space.values() for entry in entries]


class Slots:
    """Where the r-th piece of a length goes: sequence and offset."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        found: dict[int, list[tuple[int, int, int]]] = {}
        self.sequences = 0
        for packs, pattern in patterns:
            offset = 0
            for length in pattern:
                found.setdefault(length, []).append((packs, self.sequences, offset))
                offset += length
            self.sequences += packs
        self.by_length = {}
        for length, slots in found.items():
            packs, first, offset = (np.array(column, dtype=np.int64) for column in zip(*slots))
            ends = np.cumsum(packs)
            self.by_length[length] = (ends, ends - packs, first, offset)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
        for rows in np.split(order, cuts[1:]):
            if len(rows):
                ends, starts, first, offsets = self.by_length[int(length[rows[0]])]
                slot = np.searchsorted(ends, rank[rows], side="right")
                sequence[rows] = first[slot] + rank[rows] - starts[slot]
                offset[rows] = offsets[slot]
        return sequence, offset


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to ``capacity`` ids.

    ``pieces`` is read twice and must be stored. ``order`` are columns that tell rows apart;
    rows that agree in all of them are interchangeable.
    """
    pieces = pieces.drop("sequence_id", "offset", "_bucket", "_row", "_base", "_slot")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    if histogram and not (1 <= min(histogram) and max(histogram) <= capacity):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    slots = Slots(shortest_pack_first(histogram, capacity))
    buckets = F.lit([-(-histogram.get(n, 1) // RANKED_ROWS) for n in range(1, capacity + 1)])
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.element_at(buckets, F.col(length).cast("int"))).cast("int"))
    counts = spread.groupBy(length, "_bucket").count()
    base = F.sum("count").over(Window.partitionBy(length).orderBy("_bucket")) - F.col("count")
    counts = counts.select(length, "_bucket", base.alias("_base"))
    row = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order))
    ranked = spread.withColumn("_row", row.cast("long")).join(counts, [length, "_bucket"])

    @F.arrow_udf("sequence_id long, offset long")
    def slot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        found = slots.place(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(column) for column in found], names=["sequence_id", "offset"])

    placed = ranked.withColumn("_slot", slot(F.col(length).cast("long"), F.col("_base") + F.col("_row") - 1))
    return placed.select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


ORDER = ["start", "ids_crc32", "doc_tokens"]


def pack_documents(docs: DataFrame) -> DataFrame:
    """The pieces of documents (doc_id, text) and their places, without the ids themselves."""
    pieces = materialize(token_pieces(docs, keep_ids=False), "pieces")
    return pack(pieces, ["doc_id", *ORDER])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": (op1_packing, None)}
