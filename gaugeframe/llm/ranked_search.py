"""Ranked lexical search by Block-Max MaxScore (operator 11).

``build_index`` stores an inverted index over all words of all documents: per shard (documents of
about ``SHARD_BYTES`` of text) and term one row with the postings in blocks of ``BLOCK``. A block
is packed relative to its first document in the fewest bytes its list allows; beside it stand the
(frequency, shortest length) pairs from which its largest contribution follows for any corpus
statistics. The index is built where the documents lie, without a shuffle, and serves any later query.

``search`` sends the lists of the asked terms to one task per shard and block of items. There each
item keeps a heap of its best documents. Terms are ordered by the largest contribution of their
list in the shard: the lists whose sum cannot lift a document over the heap's last score are not
essential, and only documents of essential lists are candidates. A candidate goes through the
non-essential lists from the largest on and is rejected as soon as the maximum of the block it
would be in, and of the lists still to come, leaves it below; only blocks with candidates left are
unpacked. The heaps of the shards are merged. The result is exact.

Null texts and texts without terms are no documents of the statistics and never found. Items
without terms give no rows; rows that share an item id (null is one too) are one item with the
terms of all. Rows that share a doc_id are documents of their own; a null doc_id comes last among equal
scores. A very long text is a shard of its own. Without documents or items the result is empty.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.arrowtext import LOWER, byte_class, slices, words
from gaugeframe.llm.data import read, stored

SHARD_BYTES = 32 << 20
SHARD_DOCS = 1 << 16
BLOCK = 128
#: Items searched together in a task, on average.
ITEMS = 256
#: Pairs of an item and a term up to which the asked terms are sent to every executor.
SENT_PAIRS = 500_000
FIRST_CHUNK, LAST_CHUNK = 256, 8192

# Fixed value: terms are runs of these bytes; all bytes above 0x7F belong to terms.
TERM_BYTES = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = (
    "shard long, term binary, df int, first binary, gap_bytes int, gaps binary, tf_bytes int, tfs binary, "
    "pair_ends binary, pair_tf binary, pair_n binary, doc_ids array<long>, lengths array<int>"
)
FOUND = "item_id long, doc_id long, score long"


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after the other, and their offsets."""
    size = end - start
    offsets = np.append(0, np.cumsum(size))
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose value ``i`` is ``data[offsets[i]:offsets[i + 1]]`` (in items of data)."""
    raw = np.ascontiguousarray(data)
    at = pa.py_buffer((offsets * raw.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(raw.tobytes())])


def _packed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Bytes per value of each list (1, 2 or 4), and the lists in that width, little-endian."""
    offsets = np.append(0, np.cumsum(sizes))
    largest = np.maximum.reduceat(values, offsets[:-1]) if len(sizes) else values[:0]
    width = np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))
    each = np.repeat(width, sizes)
    ends = np.cumsum(each)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for byte in range(4):
        rows = each > byte
        out[(ends - each)[rows] + byte] = (values[rows] >> (8 * byte)) & 255
    return width, _binary(out, np.append(0, np.cumsum(width * sizes)))


class _Shard:
    """Collects the terms of documents until it holds enough text."""

    def __init__(self):
        self.bytes = 0
        self.docs: list[tuple[list, np.ndarray]] = []
        self.count = 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts, ids: list) -> None:
        found = words(texts, TERM_BYTES, lower=True)
        lengths = np.diff(found.bounds)
        rows = np.flatnonzero(lengths)
        if not len(rows):
            return
        doc = np.repeat(np.arange(len(rows)), lengths[rows]) + self.count
        order = np.lexsort((doc, found.hash))
        term, doc = found.hash[order], doc[order]
        fresh = np.ones(len(term), dtype=bool)
        fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(fresh)
        self.parts.append((term[at], doc[at], np.diff(np.append(at, len(term)))))
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]
        example = order[new]
        self.names.append((term[new], *_gathered(LOWER[texts.bytes], found.start[example], found.end[example])))
        self.docs.append(([ids[r] for r in rows], lengths[rows]))
        self.count += len(rows)
        self.bytes += len(texts.bytes)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids = [i for listed, _ in self.docs for i in listed]
        lengths = np.concatenate([n for _, n in self.docs]).astype(np.int64)
        # Documents in order of their ids, nulls last: of equal scores the first one is wanted.
        number = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        by_id = np.lexsort((number, np.array([i is None for i in ids])))
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        lengths = lengths[by_id]
        term, doc, tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sizes = np.diff(np.append(start, len(term)))
        # The text of each term, from any part.
        names = np.concatenate([n for n, _, _ in self.names])
        base = np.cumsum([0, *[len(raw) for _, raw, _ in self.names]])
        begins = np.concatenate([o[:-1] + b for (_, _, o), b in zip(self.names, base)])
        stops = np.concatenate([o[1:] + b for (_, _, o), b in zip(self.names, base)])
        _, example = np.unique(names, return_index=True)
        text, offsets = _gathered(np.concatenate([raw for _, raw, _ in self.names]), begins[example], stops[example])
        # Blocks of each list.
        within = np.arange(len(doc)) - np.repeat(start, sizes)
        opens = within % BLOCK == 0
        block = np.cumsum(opens) - 1
        first = doc[opens]
        blocks = -(-sizes // BLOCK)
        gap_bytes, gaps = _packed(doc - first[block], sizes)
        tf_bytes, tfs = _packed(tf, sizes)
        # Of each frequency in a block, the shortest document.
        by = np.lexsort((lengths[doc], tf, block))
        lead = np.ones(len(by), dtype=bool)
        lead[1:] = (block[by][1:] != block[by][:-1]) | (tf[by][1:] != tf[by][:-1])
        pair = by[lead]
        ends = np.cumsum(np.bincount(block[pair], minlength=len(first)))
        block_offsets = np.append(0, np.cumsum(blocks))
        pair_offsets = np.append(0, ends)[block_offsets]
        # Ends count from the list's own first pair.
        ends = ends - np.repeat(pair_offsets[:-1], blocks)
        n = len(start)
        schema = ["shard", "term", "df", "first", "gap_bytes", "gaps", "tf_bytes", "tfs", "pair_ends", "pair_tf", "pair_n", "doc_ids", "lengths"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), _binary(text, offsets), pa.array(sizes.astype(np.int32)),
                _binary(first.astype("<u2"), block_offsets), pa.array(gap_bytes.astype(np.int32)), gaps,
                pa.array(tf_bytes.astype(np.int32)), tfs, _binary(ends.astype("<u4"), block_offsets),
                _binary(tf[pair].astype("<u4"), pair_offsets), _binary(lengths[doc[pair]].astype("<u4"), pair_offsets),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
            ],
            names=schema,
        )
        listed = pa.array([[ids[i] for i in by_id]], type=pa.list_(pa.int64()))
        empty = {"term": pa.binary(), "df": pa.int32(), "first": pa.binary(), "gap_bytes": pa.int32(), "gaps": pa.binary(), "tf_bytes": pa.int32()}
        empty |= {name: pa.binary() for name in ("tfs", "pair_ends", "pair_tf", "pair_n")}
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), *[pa.nulls(1, kind) for kind in empty.values()], listed, pa.array([lengths.astype(np.int32)], type=pa.list_(pa.int32()))],
            names=schema,
        )


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row per shard and term, and a row per shard (null term) with its documents."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                if shard.count and (shard.bytes + len(part.bytes) > SHARD_BYTES or shard.count + len(part) > SHARD_DOCS):
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
                shard.add(part, ids[part.first : part.first + len(part)])
        if shard.count:
            yield from shard.rows(number)

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return stored(rows.mapInArrow(shards, INDEX), "ranked-index")


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once."""
    found = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWERED), F.lit(TERM_PATTERN), F.lit(0))
    rows = items.select(F.col(f"`{item}`").cast("long").alias("item_id"), F.explode(found).alias("term"))
    return rows.distinct().select("item_id", F.encode("term", "UTF-8").alias("term"))


class _List:
    """The postings of one term in one shard, unpacked block by block when asked for."""

    def __init__(self, row: dict, w: int, m: np.ndarray, length_m):
        self.w, self.m = w, m
        self.first = np.frombuffer(row["first"], "<u2").astype(np.int64)
        self.size = row["df"]
        self.gaps = np.frombuffer(row["gaps"], f"<u{row['gap_bytes']}")
        self.tfs = np.frombuffer(row["tfs"], f"<u{row['tf_bytes']}")
        tf = np.frombuffer(row["pair_tf"], "<u4").astype(np.int64)
        best = w * impact(tf, length_m(np.frombuffer(row["pair_n"], "<u4").astype(np.int64)))
        ends = np.frombuffer(row["pair_ends"], "<u4").astype(np.int64)
        self.most = np.maximum.reduceat(best, np.append(0, ends[:-1]))
        self.bound = int(self.most.max())
        # What is still packed stands at its block's first document, so the order holds throughout.
        self.docs = np.repeat(self.first, BLOCK)[: self.size]
        self.scores = np.zeros(self.size, dtype=np.int64)
        self.ready = np.zeros(len(self.first), dtype=bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        self.ready[blocks] = True
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < self.size]
        docs = self.first[at // BLOCK] + self.gaps[at]
        self.docs[at] = docs
        self.scores[at] = self.w * impact(self.tfs[at].astype(np.int64), self.m[docs])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores with low <= document < high."""
        b = max(int(np.searchsorted(self.first, low, "right")) - 1, 0)
        e = int(np.searchsorted(self.first, high, "left"))
        if e <= b:
            return self.docs[:0], self.scores[:0]
        self.unpack(np.arange(b, e))
        i = b * BLOCK + int(np.searchsorted(self.docs[b * BLOCK : e * BLOCK], low))
        j = b * BLOCK + int(np.searchsorted(self.docs[b * BLOCK : e * BLOCK], high))
        return self.docs[i:j], self.scores[i:j]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best_documents(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of highest score above 0, best first, equal scores by place."""
    lists = sorted(lists, key=lambda x: x.bound)
    sums = np.cumsum([x.bound for x in lists])
    top_score, top_doc, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    low, size = 0, FIRST_CHUNK
    while low < n_docs:
        high = min(low + size, n_docs)
        essential = int(np.searchsorted(sums, least, "right"))
        if essential == len(lists):
            break
        held = np.zeros(high - low, dtype=np.int64)
        for x in lists[essential:]:
            docs, scores = x.between(low, high)
            held[docs - low] += scores
        docs = np.flatnonzero(held)
        score = held[docs]
        docs += low
        for i in range(essential - 1, -1, -1):
            open_ = score + sums[i] > least
            if not open_.all():
                docs, score = docs[open_], score[open_]
            if not len(docs):
                break
            x, rest = lists[i], int(sums[i - 1]) if i else 0
            block = np.searchsorted(x.first, docs, "right") - 1
            most = np.where(block >= 0, x.most[block], 0)
            open_ = score + most + rest > least
            if not open_.all():
                docs, score, block = docs[open_], score[open_], block[open_]
            rows = np.flatnonzero(block >= 0)
            if len(rows):
                x.unpack(np.unique(block[rows]))
                at = np.minimum(np.searchsorted(x.docs, docs[rows], "left"), x.size - 1)
                hit = x.docs[at] == docs[rows]
                score[rows[hit]] += x.scores[at[hit]]
        better = score > least
        if better.any():
            top_score = np.concatenate([top_score, score[better]])
            top_doc = np.concatenate([top_doc, docs[better]])
            best = np.lexsort((top_doc, -top_score))[:k]
            top_score, top_doc = top_score[best], top_doc[best]
            if len(best) == k:
                least = int(top_score[-1])
        low, size = high, min(2 * size, LAST_CHUNK)
    return top_doc, top_score


def search(index: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of every item."""
    shards = index.where("term is null").select("shard", "doc_ids", "lengths")
    total = shards.select(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 1
    pairs = stored(item_terms(items, item, text), "ranked-terms")
    counts = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    n_blocks = max(-(-counts["items"] // ITEMS), 1)
    sent = F.broadcast if counts["pairs"] <= SENT_PAIRS else lambda table: table
    lists = index.where("term is not null").drop("doc_ids", "lengths")
    df = lists.select("term", "df").join(sent(pairs.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("n") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int").alias("block")
    asked = pairs.join(df.select("term", weight.alias("w")), "term").groupBy("term", "w", block).agg(F.collect_list(F.struct("item_id")).alias("items"))
    wanted = lists.join(sent(stored(asked, "ranked-asked")), "term")
    # A name of its own keeps the two sides of the cogroup, read from one table, apart.
    dealt = shards.withColumnRenamed("shard", "home").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def length_m(lengths: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * lengths * n) // length

    def found(rows: pa.Table, shard: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and shard.num_rows:
            ids = shard["doc_ids"][0].as_py()
            m = length_m(shard["lengths"][0].values.to_numpy().astype(np.int64))
            by_item: dict = {}
            for row in rows.to_pylist():
                postings = _List(row, row["w"], m, length_m)
                for each in row["items"]:
                    by_item.setdefault(each["item_id"], []).append(postings)
            for name, lists_of_item in by_item.items():
                docs, scores = best_documents(lists_of_item, len(ids), k)
                out[0].extend([name] * len(docs))
                out[1].extend(ids[d] for d in docs.tolist())
                out[2].extend(scores.tolist())
        return pa.table([pa.array(values, type=pa.int64()) for values in out], names=["item_id", "doc_id", "score"])

    heaps = wanted.groupBy("shard", "block").cogroup(dealt.groupBy(F.col("home") + 0, "block")).applyInArrow(found, FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read(spark, sf_dir, "documents"))
    return search(index, read(spark, sf_dir, "benchmark"))


SEARCH_SQL = rf"""
WITH words AS (
  SELECT row_id, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '{TERM_PATTERN}')) AS term
  FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)),
postings AS (SELECT row_id, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT row_id, sum(tf)::BIGINT AS n FROM postings GROUP BY row_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWERED}'), '{TERM_PATTERN}')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (row_id), total
  GROUP BY item_id, row_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op11_ranked_search": (op11_ranked_search, SEARCH_SQL)}
