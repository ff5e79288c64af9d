"""Near-duplicate documents by HyperMinHash (operator 9).

A document is the set of its distinct word shingles (64-bit hashes). Its signature has 256
registers: each shingle falls into one bucket, and the smallest value of a bucket is stored
as its number of leading zeros (6 bits) and its next 10 bits (the mantissa). Empty registers
borrow from others in an order that depends on the register only, so that small sets band as
well as large ones. Four registers make a band key; 64 bands find a pair of similarity 0.8
with all but 10**-14 of certainty.

Documents with equal sets are one node from the start. In every bucket of equal band keys all
nodes meet the smallest one (never each other). A pair whose Jaccard estimate, corrected for
chance collisions of registers, is six deviations below the threshold goes; the others are
confirmed on their full sets. Components of the confirmed links follow. Members of a group that
are not in the component of its smallest node are then compared with the whole group on full
sets, in blocks inside tasks, which makes up for links that do not run over the smallest node;
of these only the links leave a task.

Nulls, empty texts: an empty set, linked with nothing. Rows that share a doc_id are linked by
``near_duplicates``, which tells components of ids; ``kept_documents`` links rows by their texts.
Rows without an id take part in no link and are kept. Ties: equal sets are copies, the
smallest doc_id stands for them. An empty table gives an empty result. Extra columns, whatever
their names, are not read by ``near_duplicates`` and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.anchors import squeezed, unsqueezed
from gaugeframe.llm.arrowtext import NON_SPACE, RangeHash, Words, mix, slices, words
from gaugeframe.llm.components import components
from gaugeframe.llm.data import read, stored

REGISTERS = 256
MANTISSA = 10
BAND = 4
BANDS = REGISTERS // BAND
DEVIATIONS = 6
ATTEMPTS = 64
# Nodes of a group that a task compares at once.
TOGETHER = 512
# Shingles of the nodes of a group that a task compares at once, rows of a slice, and bytes of an Arrow batch.
SHINGLES, SLICE_ROWS, BATCH_BYTES = 1 << 21, 512, 16 << 20
# Ids up to which they are sent to every executor.
SENT_IDS = 1 << 20


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of k words, ordered; fewer words are one shingle."""
    lengths = np.diff(w.bounds)
    size = np.minimum(lengths, k)
    count = np.where(lengths > 0, lengths - size + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    start = w.bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    value = RangeHash(w.hash).of(start, start + size[text])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def donors() -> np.ndarray:
    """The registers from which each register borrows, in order, if it is empty."""
    grid = np.arange(REGISTERS * ATTEMPTS, dtype=np.uint64).reshape(REGISTERS, ATTEMPTS)
    return (mix(grid + np.uint64(0x5851F42D4C957F2D)) % np.uint64(REGISTERS)).astype(np.int64)


def signatures(text: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n x REGISTERS) uint16; a text without shingles has zeros only."""
    value = mix(value ^ np.uint64(0xA0761D6478BD642F))
    bucket = text * REGISTERS + (value >> np.uint64(56)).astype(np.int64)
    rest = value << np.uint64(8)
    smallest = np.full(n * REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    order = np.argsort(bucket, kind="stable")
    if len(order):
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        smallest[bucket[order][first]] = np.minimum.reduceat(rest[order], first)
    filled = np.zeros(n * REGISTERS, dtype=bool)
    filled[bucket] = True
    # 40 bits of the minimum fit a double exactly; their exponent gives the leading zeros.
    head = smallest >> np.uint64(24)
    bits = np.where(head > 0, np.frexp(head.astype(np.float64))[1], 0)
    zeros = 40 - bits
    shift = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (head >> shift) & np.uint64((1 << MANTISSA) - 1)
    register = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    register, filled = np.where(filled, register, 0).astype(np.uint16).reshape(n, REGISTERS), filled.reshape(n, REGISTERS)
    out = register.copy()
    some = filled.any(axis=1)
    order = donors()
    todo = ~filled & some[:, None]
    for attempt in range(ATTEMPTS):
        rows, cols = np.nonzero(todo)
        if not len(rows):
            break
        source = order[cols, attempt]
        full = filled[rows, source]
        out[rows[full], cols[full]] = register[rows[full], source[full]]
        todo[rows[full], cols[full]] = False
    # Sets of so few shingles that no attempt met one: the next filled register round the ring.
    rows = np.flatnonzero(todo.any(axis=1))
    if len(rows):
        ring = np.where(np.tile(filled[rows], 2), np.arange(2 * REGISTERS, dtype=np.int32), 2 * REGISTERS)
        following = np.minimum.accumulate(ring[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
        out[rows] = np.where(todo[rows], np.take_along_axis(register[rows], following, axis=1), out[rows])
    return out


def chance(size: np.ndarray) -> np.ndarray:
    """Probability that registers of two sets without common shingles agree, given their size.

    The smallest of m uniform values has l leading zeros with probability
    (1 - 2**-(l+1))**m - (1 - 2**-l)**m; mantissas then agree once in 2**MANTISSA.
    """
    m = np.maximum(size / REGISTERS, 1)[:, None]
    l = np.arange(40)
    p = (1 - 0.5 ** (l + 1)) ** m - (1 - 0.5**l) ** m
    return (p**2).sum(axis=1) / (1 << MANTISSA)


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows bounds[i]:bounds[i+1] of ``values`` as binary cells."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def with_signature(df: DataFrame, text: str, k: int) -> DataFrame:
    """Adds _sig: n (shingles), s1 and s2 (hashes of the set), and the registers."""

    @F.arrow_udf("n long, s1 long, s2 long, registers binary")
    def sign(texts: pa.Array) -> pa.Array:
        parts = []
        for part in (part for first in range(0, len(texts), SLICE_ROWS) for part in slices(texts.slice(first, SLICE_ROWS))):
            text_of, value = shingles(words(part, NON_SPACE, lower=True), k)
            n = len(part)
            starts = np.searchsorted(text_of, np.arange(n + 1))
            sums = [np.cumsum(np.append(np.uint64(0), mix(value ^ np.uint64(salt))), dtype=np.uint64) for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)]
            keys = [pa.array((s[starts[1:]] - s[starts[:-1]]).view(np.int64)) for s in sums]
            registers = binary(signatures(text_of, value, n).ravel(), np.arange(n + 1) * REGISTERS)
            parts.append(pa.StructArray.from_arrays([pa.array(np.diff(starts)), *keys, registers], names=["n", "s1", "s2", "registers"]))
        kind = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("registers", pa.binary())])
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return df.withColumn("_sig", sign(F.col(text)))


def with_set(texts: DataFrame, k: int, squeezed_text: bool) -> DataFrame:
    """(id, _set): the sorted distinct shingle hashes of each (id, text), a few rows at a time."""

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                ids, text = (column.slice(first, SLICE_ROWS) for column in batch.columns)
                if squeezed_text:
                    text = pa.array(list(unsqueezed(text)), type=pa.large_binary())
                for part in slices(text):
                    text_of, value = shingles(words(part, NON_SPACE, lower=True), k)
                    sets = binary(value, np.searchsorted(text_of, np.arange(len(part) + 1)))
                    yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(part)), sets], names=["id", "_set"])

    return texts.mapInArrow(as_sets, "id long, _set binary")


def sets_of(rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The stored sets of the rows (id, text) with these ids.

    Up to ``SENT_IDS`` ids go to the texts, which then stay where they are; more of them meet
    the texts in a shuffle, for which the texts are squeezed.
    """
    ids = stored(ids.distinct(), "ids")
    few = ids.count() <= SENT_IDS
    chosen = rows.select("id", "text").join(F.broadcast(ids), "id", "left_semi") if few else packed(rows).join(ids, "id", "left_semi")
    return stored(with_set(chosen.select(F.col("id").cast("long").alias("id"), "text"), k, not few), "sets")


def packed(texts: DataFrame) -> DataFrame:
    """id and text, squeezed for the shuffle."""
    return texts.select("id", squeezed(F.col("text"), 6).alias("text"))


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) that the estimate does not rule out."""

    @F.arrow_udf("double")
    def estimate(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(r.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        same = (x == y).mean(axis=1)
        c = chance(np.maximum(na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False)).astype(np.float64))
        return pa.array((same - c) / (1 - c))

    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    j = percent / 100
    margin = DEVIATIONS * F.sqrt(F.lit(j * (1 - j)) / F.least(large, F.lit(REGISTERS)))
    sized = pairs.where(small * 100 >= large * percent)
    return sized.where(estimate("ra", "rb", "na", "nb") >= j - margin).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Those pairs (a, b) of ids whose full sets are similar enough. ``texts``: id, text."""

    @F.arrow_udf("long")
    def common(xs: pa.Array, ys: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(xs, ys):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            at = np.searchsorted(y, x)
            found.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0)
        return pa.array(found, type=pa.int64())

    sets = sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), k)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("_set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("_set").alias("sb")), "b")
    i = common("sa", "sb")
    union = (F.octet_length("sa") / 8 + F.octet_length("sb") / 8).cast("long") - F.col("i")
    return both.select("a", "b", i.alias("i"), "sa", "sb").where(F.col("i") * 100 >= union * percent).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row; keys are integers. Links have 100 * common >= percent * union shingles of k words."""
    # Arrow batches of this session are bounded by bytes as well as by rows.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = with_signature(rows, "text", k).select("id", F.col("_sig.n").alias("n"), F.col("_sig.s1").alias("s1"), F.col("_sig.s2").alias("s2"), F.col("_sig.registers").alias("r"))
    signed = stored(signed, "signatures")
    usable = signed.where("n > 0 and id is not null")
    nodes = stored(usable.groupBy("s1", "s2").agg(F.min("id").alias("node"), F.min("n").alias("n")), "nodes")
    # The rows of the nodes themselves; equal rows would repeat a node.
    registers = stored(
        usable.join(nodes.select("s1", "s2", F.col("node").alias("id")), ["s1", "s2", "id"], "left_semi")
        .groupBy("id", "s1", "s2", "n").agg(F.first("r").alias("r")), "registers",
    )
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("r"), i * 2 * BAND + 1, F.lit(2 * BAND)))))
    banded = registers.select(band.alias("key"), F.col("id").alias("node"), F.col("n").alias("size"))
    leaders = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    met = stored(banded.join(leaders, "key"), "buckets")
    links = _links(met.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), registers, rows, percent, k)
    more = _beyond(met.select("leader", "node", "size").distinct(), components(links), rows, percent, k)
    root = components(links.union(more))
    member = nodes.join(root, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("component_id"))
    told = signed.join(member, ["s1", "s2"], "left")
    own = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id")))
    return told.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _beyond(groups: DataFrame, root: DataFrame, rows: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) that do not run over the leader of a group (leader, node, size).

    Nodes that share a bucket share its leader. Those that are not yet in the leader's component
    meet all nodes of the group on their full sets, in blocks of bounded size inside tasks.
    Only links are returned, one for each node and component; pairs are not made.
    """
    told = groups.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = told.where("node = leader").select("leader", F.col("root").alias("leader_root"))
    told = told.join(own, "leader").withColumn("apart", F.col("root") != F.col("leader_root"))
    sizes = told.groupBy("leader").agg(
        F.count("*").alias("n"), F.count_if("apart").alias("n_apart"), F.sum("size").alias("held"), F.sum(F.when(F.col("apart"), F.col("size"))).alias("held_apart")
    ).where("n_apart > 0")
    told = stored(told.join(sizes, "leader").select("leader", "node", "root", "apart", "n", "n_apart", "held", "held_apart"), "apart")
    sets = sets_of(rows, told.select(F.col("node").alias("id")), k).withColumnRenamed("id", "node")
    blocks, apart_blocks = (F.ceil(F.greatest(F.col(n) / TOGETHER, F.col(held) / SHINGLES)) for n, held in (("n", "held"), ("n_apart", "held_apart")))
    h = F.xxhash64("node")
    asked = told.where("apart").select(
        "leader", "node", "root", F.lit(True).alias("asks"), F.pmod(h, apart_blocks).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    met = told.select("leader", "node", "root", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), apart_blocks - 1)).alias("i"), F.pmod(h, blocks).alias("j"))
    dealt = asked.unionByName(met.select(*asked.columns)).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        node, root_of = (table.column(c).to_numpy() for c in ("node", "root"))
        parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("_set")]
        size = np.array([len(x) for x in parts])
        others = np.flatnonzero(~asks)
        owner = np.repeat(np.arange(len(others)), size[others])
        value = np.concatenate([parts[i] for i in others]) if len(others) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        found = {}
        for i in np.flatnonzero(asks):
            low, high = np.searchsorted(value, parts[i], "left"), np.searchsorted(value, parts[i], "right")
            hits = [owner[x:y] for x, y in zip(low, high) if y > x]
            common = np.bincount(np.concatenate(hits), minlength=len(others)) if hits else np.zeros(len(others), dtype=np.int64)
            near = common * 100 >= (size[i] + size[others] - common) * percent
            for j in others[near & (root_of[others] != root_of[i])]:
                pair = (int(node[i]), int(root_of[j]))
                found[pair] = min(found.get(pair, int(node[j])), int(node[j]))
        pairs = [(a, b) for (a, _), b in found.items()]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    compared = dealt.groupBy("leader", "i", "j").applyInArrow(compare, "a long, b long")
    return stored(compared.distinct(), "links")


def _links(pairs: DataFrame, registers: DataFrame, rows: DataFrame, percent: int, k: int) -> DataFrame:
    pairs = stored(pairs, "pairs")
    for side in "ab":
        own = registers.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("r").alias(f"r{side}"))
        pairs_with = pairs.join(own, side) if side == "a" else pairs_with.join(own, side)
    likely = stored(_likely(pairs_with, percent), "likely")
    return stored(_confirmed(likely, rows, percent, k).distinct(), "links")


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest key, with all columns.

    Of rows that repeat key and text one stays. Rows that share a key but not the text are
    documents of their own: all but the one of smallest hash count as larger than any key.
    Rows without a key stay.
    """
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.xxhash64(text).alias("_hash"), F.struct(*docs.columns).alias("_doc"))
    shared = stored(own.groupBy("_key").agg(F.min("_hash").alias("_first"), F.max("_hash").alias("_last")).where("_first < _last"), "shared")
    more = own.select("_key", "_hash").join(shared, "_key").where(F.col("_hash") != F.col("_first")).select("_key", "_hash").distinct()
    more = stored(more, "more")
    ends = own.agg(F.min("_key").alias("low"), F.max("_key").alias("high")).first() if more.head(1) else None
    nth = F.monotonically_increasing_id()
    if ends is not None:
        number = F.lit(ends.high) + 1 + nth if ends.high < 2**62 else F.lit(ends.low) - 1 - nth
        more = stored(more.withColumn("_number", number), "numbered")
        own = own.join(more, ["_key", "_hash"], "left").withColumn("_id", F.coalesce("_number", "_key"))
    else:
        own = own.withColumn("_id", F.col("_key"))
    texts = own.select("_id", F.col("_doc").getField(text).alias("_text"))
    gone = stored(near_duplicates(texts, "_id", "_text", k, percent).where("component_id <> _id").select("_id").distinct(), "gone")
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_hash"))
    one = own.join(gone, "_id", "left_anti").withColumn("_nth", first).where("_nth = 1")
    return one.select("_doc.*").unionByName(docs.where(F.col(key).isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, k=2)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


QUERIES = {"op9_near_dedup": (op9_near_dedup, None)}
