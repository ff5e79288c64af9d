"""Content-defined anchors of token sequences, shared by the two exact substring operators.

Of every ``window`` consecutive tokens the k-grams of smallest hash are anchors (winnowing), so
that two equal windows have equal anchors at equal places in them. Around an anchor lies its
context, the tokens of all windows that hold it. Repeats are therefore found among anchors of
equal hash, and wherever whole contexts agree nothing needs to be compared any more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.arrowtext import BYTE_VALUES, NON_SPACE, RangeHash, mix, slices, words
from gaugeframe.llm.data import stored

# Slices whose arrays stay in the processor's cache.
BYTE_SLICE, WORD_SLICE = 32 << 10, 128 << 10
OUT_BYTES = 256 << 10
ANCHOR_ROWS = 50_000
# Anchors a task gathers before it deals them out, by the highest bits of their hash; anchors compared at once, and told at once.
DEALT_ROWS, DEALT_BITS, COMPARED_ROWS = 1 << 18, 12, 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


class Sequences(NamedTuple):
    """Token values of consecutive texts, text i at bounds[i]:bounds[i + 1]."""

    values: np.ndarray
    bounds: np.ndarray


def sliding(reduce: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """reduce over x[i:i + width] for every i, by doubling."""
    span = 1
    while span * 2 <= width:
        x = reduce(x[:-span], x[span:])
        span *= 2
    return reduce(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def starts_inside(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """For every token whether ``size`` tokens of its own text begin there."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, bounds[:-1], 1)
    np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - size + 1), -1)
    return np.cumsum(edge[:-1]) > 0


def gram_hashes(hashes: RangeHash, n: int, k: int) -> np.ndarray:
    raw = (hashes.sums[k : n + 1] - hashes.sums[: n - k + 1]) * hashes.back[: n - k + 1]
    raw ^= raw >> np.uint64(32)
    raw *= np.uint64(0x9E3779B97F4A7C15)
    raw ^= raw >> np.uint64(29)
    return raw


class Anchors(NamedTuple):
    """Token index, k-gram hash, context hash, and how far the context reaches before and from the index."""

    at: np.ndarray
    hash: np.ndarray
    context: np.ndarray
    left: np.ndarray
    right: np.ndarray


def anchors(seq: Sequences, k: int, window: int) -> Anchors:
    """Every window chooses its leftmost smallest k-gram; an anchor is one that was chosen.

    Its context is the union of the windows that chose it.
    """
    n, w = len(seq.values), window - k + 1
    inside = np.flatnonzero(starts_inside(seq.bounds, window, n))
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    hashes = RangeHash(seq.values)
    gram = gram_hashes(hashes, n, k)
    # The place in the low bits lets a minimum tell where it is, and the leftmost one win.
    index = np.arange(len(gram), dtype=np.uint64)
    lowest = sliding(np.minimum, (gram & ~_PLACE) | (index & _PLACE), w)
    first = index[: len(lowest)]
    chosen = (first + ((lowest - first) & _PLACE)).astype(np.int64)
    chosen = chosen[inside]
    head = np.flatnonzero(np.diff(chosen, prepend=-1))
    tail = np.append(head[1:], len(chosen)) - 1
    at, start, end = chosen[head], inside[head], inside[tail] + window
    context = mix(hashes.of(start, end) ^ ((at - start + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return Anchors(at, mix(gram[at]), context, at - start, end - at)


def anchors_of(doc: np.ndarray, u: np.ndarray, first: int, seq: Sequences, k: int, window: int) -> list[np.ndarray]:
    """The columns h, c, doc, u, pos and reach (left * 65536 + right) of the anchors of texts of a batch."""
    a = anchors(seq, k, window)
    text = np.searchsorted(seq.bounds, a.at, side="right") - 1
    row = first + text
    columns = [a.hash.view(np.int64), a.context.view(np.int64), doc[row], u[row], (a.at - seq.bounds[text]).astype(np.int32)]
    return [*columns, (a.left * 65536 + a.right).astype(np.int32)]


def anchor_rows(docs: DataFrame, tokens: Callable[[pa.Array], Iterator[tuple[int, Sequences]]], k: int, window: int) -> DataFrame:
    """(h, c, doc, u, pos, reach) of every anchor of ``docs`` (doc, u, t); reach is left * 65536 + right."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "doc", "u", "pos", "reach"]
        for batch in batches:
            doc, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held, size = [], 0
            for first, seq in tokens(batch.column(2)):
                held.append(anchors_of(doc, u, first, seq, k, window))
                size += len(held[-1][0])
                if size > ANCHOR_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=names)

    return docs.where("doc is not null").select("doc", "u", "t").mapInArrow(find, "h long, c long, doc long, u long, pos int, reach int")


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, u, t): u tells apart rows that share a key; it is 0 if none do."""
    repeated = not docs.groupBy(key).count().where("count > 1").isEmpty()
    u = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return docs.select(F.col(key).cast("long").alias("doc"), u.alias("u"), F.col(text).alias("t"))


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """The anchors whose hash occurs more than once, stored.

    The hashes are counted (with partial counts per task), stored and joined back, so that a
    frequent anchor is split like any skewed join key. The anchors themselves are computed
    twice rather than stored.
    """
    twice = stored(rows.groupBy("h").count().where("count > 1").select("h"), "hashes")
    return stored(rows.join(twice.hint("shuffle_hash"), "h"), "anchors")


class Compared(NamedTuple):
    """``whole``: spans (doc, u, start, end) of anchors whose whole context occurs before.
    ``open``: the others (key, n, doc, u, pos, reach), whose anchor has n contexts."""

    whole: DataFrame
    open: DataFrame


def compared(found: DataFrame, order: tuple[str, ...]) -> Compared:
    """Splits stored repeated anchors by whether an earlier equal context decides them.

    ``order`` says what earlier is: ("doc",) or ("doc", "pos").
    """
    classes = stored(found.groupBy("h", "c").agg(F.min(F.struct(*order)).alias("first")), "contexts")
    several = classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    told = found.join(classes.join(several, "h", "left"), ["h", "c"])
    later = F.struct(*order) > F.col("first")
    told = told.where(later | F.col("n").isNotNull()).select(F.when(~later, F.col("h")).alias("key"), F.when(~later, F.col("n")).alias("n"), "doc", "u", "pos", "reach")
    return split(stored(told, "compared"))


def split(told: DataFrame) -> Compared:
    whole = told.where("key is null").select("doc", "u", (F.col("pos") - left_of()).alias("start"), (F.col("pos") + right_of()).alias("end"))
    return Compared(whole, told.where("key is not null"))


ANCHOR = np.dtype([("h", "<i8"), ("c", "<i8"), ("doc", "<i8"), ("u", "<i8"), ("pos", "<i4"), ("reach", "<i4")])
PLACE = np.dtype([("doc", "<i8"), ("u", "<i8"), ("pos", "<i4"), ("reach", "<i4")])


class Classes(NamedTuple):
    """Anchors in the order of hash, context and place: whether an earlier one has their context, and how many contexts their hash has."""

    rows: np.ndarray
    later: np.ndarray
    n: np.ndarray


def classes_of(rows: np.ndarray) -> Classes:
    rows = rows[np.lexsort([rows[name] for name in ("u", "pos", "doc", "c", "h")])]
    new_hash = np.append(True, rows["h"][1:] != rows["h"][:-1])[: len(rows)]
    heads = new_hash | np.append(True, rows["c"][1:] != rows["c"][:-1])[: len(rows)]
    first = rows[np.flatnonzero(heads)][np.cumsum(heads) - 1]
    later = (rows["doc"] != first["doc"]) | (rows["pos"] != first["pos"]) | (rows["u"] != first["u"])
    starts = np.flatnonzero(new_hash)
    n = np.add.reduceat(heads, starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    return Classes(rows, later, n[np.cumsum(new_hash) - 1])


def by_hash(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors whose hash no other has, the others)."""
    order = np.argsort(rows["h"])
    h = rows["h"][order]
    same = h[1:] == h[:-1]
    alone = ~(np.append(same, False) | np.append(False, same))[: len(rows)]
    return rows[order[alone]], rows[order[~alone]]


def compared_at_once(docs: DataFrame, tokens: Callable[[pa.Array], Iterator[tuple[int, Sequences]]], k: int, window: int) -> Compared:
    """What :func:`compared` tells of all repeated anchors, by place (doc, pos, u), after one pass over the texts and one shuffle.

    Anchors travel packed, dealt by the highest bits of their hash. A task first compares its own
    anchors and deals out only the earliest of every context, so a context that a great many texts
    share is one anchor a task; the others are told at once.
    """

    def told(rows: np.ndarray, key: np.ndarray | None = None, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        none = None if key is not None else pa.nulls(len(rows), pa.int64())
        columns = [pa.array(key) if none is None else none, pa.array(n) if none is None else none]
        columns += [pa.array(np.ascontiguousarray(rows[name])) for name in ("doc", "u", "pos", "reach")]
        table = pa.RecordBatch.from_arrays(columns, names=["key", "n", "doc", "u", "pos", "reach"])
        for at in range(0, len(rows), ANCHOR_ROWS):
            yield table.slice(at, ANCHOR_ROWS)

    def dealt(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = np.empty(sum(len(part[0]) for part in held), dtype=ANCHOR)
        for name, parts in zip(ANCHOR.names, zip(*held)):
            rows[name] = np.concatenate(parts)
        alone, others = by_hash(rows)
        own = classes_of(others)
        rows, gone = np.concatenate([alone, own.rows[~own.later]]), own.rows[own.later]
        share = rows["h"] >> (64 - DEALT_BITS)
        order = np.argsort(share, kind="stable")
        rows, share = rows[order], share[order]
        starts = np.flatnonzero(np.append(True, share[1:] != share[:-1])[: len(share)])
        # What is told already goes along, in equal parts.
        places = np.empty(len(gone), dtype=PLACE)
        for name in PLACE.names:
            places[name] = gone[name]
        columns = [pa.array(share[starts].astype(np.int32)), packed(rows, np.append(starts, len(rows))), packed(places, np.linspace(0, len(gone), len(starts) + 1).astype(np.int64))]
        table = pa.RecordBatch.from_arrays(columns, names=["share", "anchors", "told"])
        for at in range(0, len(starts), 1 << 10):
            yield table.slice(at, 1 << 10)

    def packed(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
        size = rows.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * size).astype(np.int32)), pa.py_buffer(rows.tobytes())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            doc, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, seq in tokens(batch.column(2)):
                held.append(anchors_of(doc, u, first, seq, k, window))
                size += len(held[-1][0])
                if size >= DEALT_ROWS:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)

    def settled(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, others = by_hash(np.frombuffer(b"".join(held), dtype=ANCHOR))
        found = classes_of(others)
        yield from told(found.rows[found.later])
        open_ = ~found.later & (found.n > 1)
        yield from told(found.rows[open_], np.ascontiguousarray(found.rows["h"][open_]), found.n[open_])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, places, known = [], 0, None, [], 0
        for batch in batches:
            for share, rows, told_already in zip(*(column.to_pylist() for column in batch.columns)):
                if share != last and size >= COMPARED_ROWS * ANCHOR.itemsize:
                    yield from settled(held)
                    held, size = [], 0
                last = share
                held.append(rows)
                size += len(rows)
                places.append(told_already)
                known += len(told_already)
            if known >= ANCHOR_ROWS * PLACE.itemsize:
                yield from told(np.frombuffer(b"".join(places), dtype=PLACE))
                places, known = [], 0
        yield from told(np.frombuffer(b"".join(places), dtype=PLACE))
        yield from settled(held)

    parts = docs.where("doc is not null").select("doc", "u", "t").mapInArrow(deal, "share int, anchors binary, told binary")
    parts = parts.repartition("share").sortWithinPartitions("share")
    return split(stored(parts.mapInArrow(settle, "key long, n long, doc long, u long, pos int, reach int"), "compared"))


def left_of():
    return F.floor(F.col("reach") / 65536).cast("int")


def right_of():
    return F.col("reach") % 65536


def contexts(docs: DataFrame, rows: DataFrame, unit: int, data_of: Callable[[bytes], bytes]) -> DataFrame:
    """The open anchors with their contexts: (key, n, doc, u, pos, left, data), stored.

    ``data_of`` turns a text into token values of ``unit`` bytes each.
    """
    lists = rows.groupBy("doc", "u").agg(F.collect_list(F.struct("key", "n", "pos", "reach")).alias("a"))
    held = docs.where("doc is not null").select("doc", "u", squeezed(F.col("t")).alias("z")).join(lists, ["doc", "u"])
    held = held.select("doc", "u", "z", "a.key", "a.n", "a.pos", "a.reach")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[] for _ in range(7)], 0
            lists = zip(*(batch.column(j).to_pylist() for j in (0, 1, 3, 4, 5, 6)))
            for text, (doc, u, *own) in zip(unsqueezed(batch.column(2)), lists):
                data = data_of(text)
                for key, n, pos, reach in zip(*own):
                    left, right = divmod(reach, 65536)
                    for column, value in zip(out, (key, n, doc, u, pos, left, data[(pos - left) * unit : (pos + right) * unit])):
                        column.append(value)
                    size += (left + right) * unit
                if size > OUT_BYTES:
                    yield rows_of(out)
                    out, size = [[] for _ in range(7)], 0
            if out[0]:
                yield rows_of(out)

    def rows_of(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=["key", "n", "doc", "u", "pos", "left", "data"])

    return stored(held.mapInArrow(cut, "key long, n long, doc long, u long, pos int, left int, data binary"), "contexts")


def agreeing(x: bytes, y: bytes, unit: int, backwards: bool) -> int:
    """How many tokens agree from the start, or from the end."""
    kind = {1: np.uint8, 8: np.uint64}[unit]
    a, b = np.frombuffer(x, dtype=kind), np.frombuffer(y, dtype=kind)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if backwards else np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def extended(group: DataFrame, order: tuple[str, ...], unit: int, window: int) -> tuple[DataFrame, DataFrame]:
    """One round of extension: (spans, what is left).

    Every context of a key meets the earliest one, and the match at the anchor is extended
    both ways. Windows inside the match are spans. Those beyond it can only be shared with
    contexts that leave the earliest one at the same place in the same way, so contexts that
    agree there go on together under a new key.
    """
    first = group.groupBy("key").agg(F.min(F.struct("doc", "pos", "u", "left", "data")).alias("f"))
    lead = first.select("key", F.col("f.doc").alias("f_doc"), F.col("f.pos").alias("f_pos"), F.col("f.u").alias("f_u"), F.col("f.left").alias("f_left"), F.col("f.data").alias("f_data"))
    met = group.join(lead, "key").where("not (doc = f_doc and pos = f_pos and u = f_u)")

    @F.arrow_udf("lo int, hi int, more array<binary>")
    def extend(data: pa.Array, left: pa.Array, f_data: pa.Array, f_left: pa.Array) -> pa.Array:
        los, his, more = [], [], []
        for x, l, y, m in zip(*(c.to_pylist() for c in (data, left, f_data, f_left))):
            before = agreeing(x[: l * unit], y[: m * unit], unit, True)
            after = agreeing(x[l * unit :], y[m * unit :], unit, False)
            least = l - (len(x) // unit - window)
            los.append(max(window - after, least))
            his.append(min(before, l))
            beyond = []
            if before < l:
                beyond.append(b"L%d:" % before + x[(l - before - 1) * unit : l * unit])
            if after < window - least:
                beyond.append(b"R%d:" % after + x[l * unit : (l + after + 1) * unit])
            more.append(beyond)
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.binary()))
        return pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip((los, his, more), kinds)], names=["lo", "hi", "more"])

    met = stored(met.withColumn("e", extend("data", "left", "f_data", "f_left")).drop("f_data"), "extended")
    earlier = F.struct(*(f"f_{c}" for c in order)) < F.struct(*order)
    spans = met.where(earlier & (F.col("e.lo") <= F.col("e.hi"))).select("doc", "u", (F.col("pos") - F.col("e.hi")).alias("start"), (F.col("pos") - F.col("e.lo") + window).alias("end"))
    rest = met.select("key", F.explode("e.more").alias("m"), "doc", "u", "pos", "left", "data")
    rest = rest.select(F.xxhash64("key", "m").alias("key"), "doc", "u", "pos", "left", "data")
    several = rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return spans, stored(rest.join(several, "key").select("key", "n", "doc", "u", "pos", "left", "data"), "left")


def squeezed(text, level: int = 1) -> F.Column:
    """Texts as zstandard frames, for shuffles."""

    @F.arrow_udf("binary")
    def squeeze(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=level)
        cells = (x.as_py() for x in texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()))
        return pa.array([None if v is None else pack.compress(v) for v in cells], type=pa.binary())

    return squeeze(text)


def unsqueezed(cells: pa.Array) -> Iterator[bytes]:
    """The UTF-8 texts of ``squeezed`` cells, one at a time; a null is empty."""
    unpack = zstandard.ZstdDecompressor()
    return (b"" if cell is None else unpack.decompress(cell) for cell in (x.as_py() for x in cells))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document (doc, u, z) with its spans (starts, ends), null if it has none.

    A document's spans are no more than its own anchors and windows. Documents without a key
    have no spans and go round the join.
    """
    lists = spans.groupBy("doc", "u").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    lists = lists.select("doc", "u", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    packed = docs.select("doc", "u", squeezed(F.col("t")).alias("z"))
    joined = packed.where("doc is not null").join(lists, ["doc", "u"], "left")
    none = F.lit(None).cast("array<int>")
    return joined.unionByName(packed.where("doc is null").withColumns({"starts": none, "ends": none}))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions 0 to n - 1 that lie in a span."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def byte_sequences(column: pa.Array) -> Iterator[tuple[int, Sequences]]:
    for part in slices(column, BYTE_SLICE):
        yield part.first, Sequences(BYTE_VALUES[part.bytes], part.offsets)


def word_sequences(column: pa.Array) -> Iterator[tuple[int, Sequences]]:
    for part in slices(column, WORD_SLICE):
        w = words(part, NON_SPACE)
        yield part.first, Sequences(w.hash, w.bounds)
