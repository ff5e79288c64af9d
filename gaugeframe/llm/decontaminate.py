"""Benchmark decontamination with a distributed positional inverted index (operator 8).

Phrases are windows of consecutive benchmark words. A first pass over the documents counts
how often each benchmark word occurs; the rarest word of a phrase is its seed. A second pass
stores the index: for every document that holds a seed, the sorted positions of each benchmark
word in it (words that no phrase uses cannot be searched and are left out). The index is
partitioned by document. A search takes the postings of a phrase's seed, shifts them by the
seed's offset and intersects them with the shifted postings of its other words, rarest first.
``slop`` lets every word stand so many places off (0: exact phrases).

The phrases are the only thing sent to the tasks. Their size is measured first; a benchmark of
more than ``BLOCK_BYTES`` is searched block by block, each with tables of bounded size.

Nulls, empty texts: no words, not contaminated. Items without words have no phrase. Items that
repeat an item_id count once, items without one mark words but are not listed. Repeated
document rows are judged each. Texts of any length are indexed whole. All input columns are
kept; one that bears the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.arrowtext import ALPHANUMERIC, slices, words
from gaugeframe.llm.data import read
from gaugeframe.session import materialize

WINDOW = 10
BLOCK_BYTES = 4 << 20


class Phrases(NamedTuple):
    """Windows of the items of one block.

    ``terms`` (phrases x window, 0 beyond ``size``) are indices into ``vocabulary`` in the
    order in which a search uses them, ``offsets`` their places in the phrase.
    """

    vocabulary: np.ndarray
    terms: np.ndarray
    offsets: np.ndarray
    size: np.ndarray
    item: np.ndarray
    items: list[str | None]


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    """All windows of the items; an item of fewer words is one window."""
    part = next(slices(pa.array([text for _, text in items], type=pa.large_string()), 1 << 62), None)
    hashes, bounds = (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)) if part is None else words(part, ALPHANUMERIC, lower=True)[2:]
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    lengths = np.diff(bounds)
    size = np.minimum(lengths, window)
    count = np.where(lengths > 0, lengths - size + 1, 0)
    item = np.repeat(np.arange(len(lengths)), count)
    start = bounds[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    offsets = np.broadcast_to(np.arange(window), (len(item), window))
    inside = offsets < size[item][:, None]
    table = np.where(inside, terms[np.minimum(start[:, None] + offsets, max(len(terms) - 1, 0))] if len(terms) else 0, 0)
    return Phrases(vocabulary, table.astype(np.int32), offsets.astype(np.int32), size[item].astype(np.int32), item.astype(np.int32), [i for i, _ in items])


def rarest_first(phrases: Phrases, counts: np.ndarray) -> Phrases:
    """Orders the terms of each phrase by corpus count; phrases with an absent term go."""
    inside = np.arange(phrases.terms.shape[1]) < phrases.size[:, None]
    seen = np.where(inside, counts[phrases.terms], np.iinfo(np.int64).max) if len(counts) else np.zeros(phrases.terms.shape, dtype=np.int64)
    found = seen.min(axis=1) > 0 if len(seen) else np.zeros(0, dtype=bool)
    order = np.argsort(seen, axis=1, kind="stable")[found]
    terms, offsets = phrases.terms[found], phrases.offsets[found]
    return phrases._replace(
        terms=np.take_along_axis(terms, order, axis=1), offsets=np.take_along_axis(offsets, order, axis=1),
        size=phrases.size[found], item=phrases.item[found],
    )


def _terms(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index into the vocabulary, and whether the word is in it."""
    if not len(vocabulary):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    term = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return term, vocabulary[term] == hashes


def term_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the vocabulary occurs in the documents; one row per word and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                term, known = _terms(words(part, ALPHANUMERIC, lower=True).hash, vocabulary)
                total += np.bincount(term[known], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    totals = np.zeros(len(vocabulary), dtype=np.int64)
    counted = docs.select(F.col(text).alias("_text")).mapInArrow(count, "term long, n long")
    for term, n in counted.groupBy("term").agg(F.sum("n")).collect():
        totals[term] = n
    return totals


def with_postings(docs: DataFrame, text: str, phrases: Phrases) -> DataFrame:
    """Adds _postings: n_words, and terms and positions of the words in use, by term then place.

    A document without any seed has no phrase and gets empty lists.
    """
    vocabulary = phrases.vocabulary
    seed = np.zeros(max(len(vocabulary), 1), dtype=bool)
    if len(phrases.terms):
        seed[phrases.terms[:, 0]] = True
    used = np.zeros(max(len(vocabulary), 1), dtype=bool)
    used[phrases.terms[np.arange(phrases.terms.shape[1]) < phrases.size[:, None]]] = True

    @F.arrow_udf("n_words long, terms array<long>, positions array<int>")
    def postings(texts: pa.Array) -> pa.Array:
        n_words, kept, terms, positions = [], [], [], []
        for part in slices(texts):
            w = words(part, ALPHANUMERIC, lower=True)
            lengths = np.diff(w.bounds)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            term, known = _terms(w.hash, vocabulary)
            seeded = np.zeros(len(lengths), dtype=bool)
            seeded[doc[known & seed[term]]] = True
            keep = np.flatnonzero(known & used[term] & seeded[doc])
            keep = keep[np.lexsort((keep, term[keep], doc[keep]))]
            n_words.append(lengths)
            kept.append(np.bincount(doc[keep], minlength=len(lengths)))
            terms.append(vocabulary[term[keep]] if len(vocabulary) else np.zeros(0, dtype=np.uint64))
            positions.append((keep - w.bounds[doc[keep]]).astype(np.int32))
        if not n_words:
            return pa.array([], type=pa.struct([("n_words", pa.int64()), ("terms", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))]))
        bounds = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(kept))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(flat)) for flat in (np.concatenate(terms).view(np.int64), np.concatenate(positions))]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n_words)), *lists], names=["n_words", "terms", "positions"])

    return docs.withColumn("_postings", postings(F.col(text)))


def matches(n_words: np.ndarray, bounds: np.ndarray, terms: np.ndarray, positions: np.ndarray, phrases: Phrases, slop: int = 0):
    """(document, start, phrase) of each occurrence; document i owns postings bounds[i]:bounds[i+1]."""
    doc = np.repeat(np.arange(len(n_words)), np.diff(bounds))
    term, _ = _terms(terms, phrases.vocabulary)
    room = n_words + 2 * slop + phrases.terms.shape[1]
    base = np.cumsum(room) - room + slop
    place = base[doc] + positions
    order = np.lexsort((place, term))
    term, place, doc = term[order], place[order], doc[order]
    width = np.int64(room.sum() + 1)
    keys = term * width + place
    # Seeds: every phrase meets the postings of its rarest term.
    low, high = np.searchsorted(term, phrases.terms[:, 0], side="left"), np.searchsorted(term, phrases.terms[:, 0], side="right")
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    posting = np.repeat(low, count) + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    doc, start = doc[posting], place[posting] - base[doc[posting]] - phrases.offsets[phrase, 0]
    fits = (start >= -slop) & (start + phrases.size[phrase] <= n_words[doc] + slop)
    doc, start, phrase = doc[fits], start[fits], phrase[fits]
    for j in range(1, phrases.terms.shape[1]):
        if not len(doc):
            break
        wanted = phrases.terms[phrase, j].astype(np.int64) * width + base[doc] + start + phrases.offsets[phrase, j]
        at = np.searchsorted(keys, wanted - slop)
        near = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= wanted + slop)
        near |= j >= phrases.size[phrase]
        doc, start, phrase = doc[near], start[near], phrase[near]
    return doc, start, phrase


def with_matches(indexed: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Adds _found: merged word spans of all occurrences, and the ids of their items."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("spans array<struct<start:int,end:int>>, items array<string>")
    def search(postings: pa.Array) -> pa.Array:
        n_words, terms, positions = (postings.field(i) for i in range(3))
        n_words = n_words.to_numpy(zero_copy_only=False)
        bounds = terms.offsets.to_numpy()
        first = bounds[0] if len(bounds) else 0
        flat = [x.values.to_numpy(zero_copy_only=False)[first : bounds[-1]] for x in (terms, positions)]
        doc, start, phrase = matches(n_words, bounds - first, flat[0].view(np.uint64), flat[1], phrases, slop)
        end = np.minimum(start + phrases.size[phrase] + slop, n_words[doc])
        start = np.maximum(start - slop, 0)
        spans, items = [[] for _ in n_words], [set() for _ in n_words]
        for i, a, b, k in sorted(set(zip(doc.tolist(), start.tolist(), end.tolist(), phrases.item[phrase].tolist()))):
            if spans[i] and a <= spans[i][-1]["end"]:
                spans[i][-1]["end"] = max(b, spans[i][-1]["end"])
            else:
                spans[i].append({"start": a, "end": b})
            items[i].add(phrases.items[k])
        listed = [sorted(x - {None}) for x in items]
        return pa.StructArray.from_arrays([pa.array(spans, type=pa.list_(span)), pa.array(listed, type=pa.list_(pa.string()))], names=["spans", "items"])

    return indexed.withColumn("_found", search(F.col("_postings")))


def benchmark_blocks(benchmark: DataFrame, text: str) -> int:
    """Into how many blocks of about ``BLOCK_BYTES`` of text a benchmark is dealt."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return -(-size // BLOCK_BYTES) or 1


def block_phrases(benchmark: DataFrame, item: str, text: str, window: int, block: int, blocks: int) -> Phrases:
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else rows
    return phrases_of([(r.i, r.t) for r in part.collect()], window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, slop: int = 0, store: str | None = None,
) -> DataFrame:
    """Adds n_words, hit_spans (merged word spans) and hit_items (sorted ids) to every document.

    ``store`` names a stored index, which holds all columns but the text; without it the
    postings go from one step to the next.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items", "_postings", "_found")
    blocks, result = benchmark_blocks(benchmark, item_text), None
    for block in range(blocks):
        phrases = block_phrases(benchmark, item, item_text, window, block, blocks)
        phrases = rarest_first(phrases, term_counts(docs, text, phrases.vocabulary))
        indexed = with_postings(docs if result is None else materialize(result, "contamination"), text, phrases)
        if store and block == blocks - 1:
            indexed = materialize(indexed.drop(text), store)
        found = with_matches(indexed, phrases, slop)
        spans, items = F.col("_found.spans"), F.col("_found.items")
        if result is None:
            found = found.withColumns({"n_words": F.col("_postings.n_words"), "hit_spans": spans, "hit_items": items})
        else:
            spans, items = merged(F.concat("hit_spans", spans)), F.array_sort(F.array_union("hit_items", items))
            found = found.withColumns({"hit_spans": spans, "hit_items": items})
        result = found.drop("_postings", "_found")
    return result


def merged(spans):
    """Sorted, overlapping or touching spans joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        touch = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("text"))
    return contamination(held, benchmark).where(F.size("hit_spans") == 0).select("doc.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"), store="postings")
    return found.select(
        "doc_id", "n_words", n_hit(F.col("hit_spans")).alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


QUERIES = {"op8_decontaminate": (op8_decontaminate, None)}
