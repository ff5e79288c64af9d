"""Toxicity scores from a bidirectional recurrent network with attention pooling (operator 12).

A text is its lower-cased words (letters, digits and all non-ASCII), of which longer ones are cut into pieces of
``PIECE`` bytes. Windows of ``WINDOW`` pieces start every ``STEP`` pieces, the last one ends with the text, and all
are scored by the network of ``llm/gru.py`` (a shorter text is read again until it fills a window): every piece is read by its bytes and, if it was seen
often enough in the sample, by a vector of its own. The evidence of a text is the logit of its
most toxic window; a logistic curve turns it into a probability.

Only a label of the whole text is known. Training therefore alternates: all windows are scored, then
the network learns the label from the highest windows of each text, and from drawn ones of texts
that are not toxic. The network learns from a bounded sample, ``TAUGHT`` rows of either label of smallest hash
with one passage of ``PASSAGE`` characters each; the curve from the ``CURVE`` rows of
smallest hash, whole, of which the network saw none. It is trained in numpy on the driver from that sample; scoring runs in
Arrow batches, window by window, over whole texts.

Null and empty texts, and texts without a word, have no window and score the share of label 1. Labels
other than 0 and 1 and rows without an id teach nothing; contradicting labels count both ways.
Rows that share an id are scored each and bounded as rows in the sample. Without labels of
both kinds every text scores the share of label 1 (0.5 if there is no label). An empty table gives an empty
table; a very long text is scored in bounded batches of windows. Of windows that tie the first is named.
An input column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import gru
from gaugeframe.llm.arrowtext import ALPHANUMERIC, BYTE_VALUES, LOWER, RangeHash, Texts, slices, words
from gaugeframe.llm.data import read
from gaugeframe.llm.quality import logistic

PIECE = 16
WINDOW, STEP = 32, 16
TAUGHT, CURVE = 1_500, 4_000
PASSAGE = 6_000
#: Sample texts that must hold a piece before it gets a vector of its own, and the most such pieces.
SEEN, KNOWN = 4, 20_000
UPDATES, WINDOWS_AN_UPDATE, DRAWN, TOP = 480, 128, 2, 2
PASSES, RATE = 12, 0.01
#: Share of the vectors of known pieces that an update leaves out, so that the bytes must carry the label too.
LEFT_OUT = 0.5
TOXIC = 0.5


class ToxicityModel(NamedTuple):
    """score = 1 / (1 + exp(-(offset + slope * evidence))); without words, the share."""

    net: dict | None
    known: np.ndarray
    offset: float
    slope: float
    share: float


class Tokens(NamedTuple):
    """Pieces of the texts of a slice: numbers into the distinct ones, by text."""

    number: np.ndarray
    bounds: np.ndarray
    pieces: gru.Pieces


def tokens(texts: Texts, known: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The pieces of a slice and the hashes of the distinct ones."""
    found = words(texts, ALPHANUMERIC, lower=True)
    data = LOWER[texts.bytes]
    size = found.end - found.start
    parts = -(-size // PIECE)
    if len(parts) and parts.max() > 1:
        ends = np.cumsum(parts)
        first = np.arange(ends[-1]) - np.repeat(ends - parts, parts)
        start = np.repeat(found.start, parts) + first * PIECE
        end = np.minimum(start + PIECE, np.repeat(found.end, parts))
        hashes = RangeHash(BYTE_VALUES[data]).of(start, end)
        bounds = np.append(0, ends)[found.bounds]
    else:
        start, end, hashes, bounds = found.start, found.end, found.hash, found.bounds
    distinct, example, number = np.unique(hashes, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
    word = np.where(known[at] == distinct, at + 1, 0) if len(known) else np.zeros(len(distinct), dtype=np.int64)
    return Tokens(number, bounds.astype(np.int64), gru.Pieces(data, start[example], end[example], word)), distinct


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of all windows of the texts with these piece bounds."""
    size = np.diff(bounds)
    count = np.where(size > WINDOW, -(-(size - WINDOW) // STEP) + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(nth * STEP, np.maximum(size[text] - WINDOW, 0))
    return text, start + bounds[:-1][text], np.minimum(size[text], WINDOW)


def evidence(net: dict, known: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Logit of the highest window of each text (NaN without words), and the piece it starts at."""
    found, _ = tokens(texts, known)
    text, start, length = windows(found.bounds)
    best, place = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
    if len(text):
        z = gru.logits(net, gru.projections(net, found.pieces), found.number, start, length, WINDOW)
        order = np.lexsort((start, -z, text))
        lead = order[np.append(True, text[order][1:] != text[order][:-1])]
        best[text[lead]] = z[lead]
        place[text[lead]] = start[lead] - found.bounds[:-1][text[lead]]
    return best, place


def evidence_column(text: Column, net: dict, known: np.ndarray) -> Column:
    """struct(evidence, window) of each text."""

    @F.arrow_udf("struct<evidence:double,window:long>")
    def scored(column: pa.Array) -> pa.Array:
        parts = [evidence(net, known, part) for part in slices(column)]
        best = np.concatenate([b for b, _ in parts]) if parts else np.zeros(0)
        place = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, dtype=np.int64)
        nothing = np.isnan(best)
        return pa.StructArray.from_arrays([pa.array(best, mask=nothing), pa.array(place, mask=nothing)], ["evidence", "window"])

    return scored(text)


def known_pieces(bounds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes of the pieces that enough sample texts hold, the most frequent if there are too many."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    once = np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])) if len(text) else np.zeros(0, dtype=bool)
    found, count = np.unique(hashes[once], return_counts=True)
    enough = np.flatnonzero(count >= SEEN)
    return np.sort(found[enough[np.lexsort((found[enough], -count[enough]))[:KNOWN]]])


def sample_tokens(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """The pieces of all sample texts, and the hashes of the known ones."""
    nothing = np.zeros(0, dtype=np.uint64)
    parts = [tokens(part, nothing) for part in slices(pa.array(texts, type=pa.large_string()))]
    bases = np.cumsum([0, *[len(t.pieces.data) for t, _ in parts]])
    counts = np.cumsum([0, *[t.bounds[-1] for t, _ in parts]])
    distinct, example = np.unique(np.concatenate([d for _, d in parts]), return_index=True)
    number = np.concatenate([np.searchsorted(distinct, d)[t.number] for t, d in parts])
    bounds = np.concatenate([[0], *[t.bounds[1:] + n for (t, _), n in zip(parts, counts)]])
    start, end = (np.concatenate([at[k] + base for (t, _), base in zip(parts, bases) for at in [(t.pieces.start, t.pieces.end)]])[example] for k in (0, 1))
    known = known_pieces(bounds, distinct[number])
    word = np.zeros(len(distinct), dtype=np.int64)
    word[np.searchsorted(distinct, known)] = np.arange(1, len(known) + 1)
    data = np.concatenate([t.pieces.data for t, _ in parts])
    return Tokens(number, bounds, gru.Pieces(data, start, end, word)), known


def train(texts: list[str], y: np.ndarray, updates: int = UPDATES, seed: int = 0) -> tuple[dict, np.ndarray]:
    """The network and its known pieces, from texts with labels 0 and 1."""
    found, known = sample_tokens(texts)
    text, start, length = windows(found.bounds)
    rng = np.random.default_rng(seed)
    net = gru.initial(len(known), seed)
    adam = gru.Adam(net, RATE)
    y = np.asarray(y, dtype=np.float32)[text]
    # The places of a text's windows in any order by text.
    nth = np.arange(len(text)) - np.flatnonzero(np.append(True, np.diff(text) > 0))[np.cumsum(np.append(False, np.diff(text) > 0))]
    updates = min(updates, PASSES * -(-int((nth < DRAWN + TOP).sum()) // WINDOWS_AN_UPDATE))
    done = 0
    while done < updates:
        chosen = np.lexsort((rng.random(len(text)), text))[nth < DRAWN + TOP]
        if done:
            z = gru.logits(net, gru.projections(net, found.pieces), found.number, start, length, WINDOW)
            order = np.lexsort((-z, text))
            # Of a toxic text the highest windows carry the label; of another one all do.
            top = order[nth < TOP]
            top = top[(y[top] == 0) | (nth[nth < TOP] == 0) | (z[top] > 0)]
            chosen = np.union1d(chosen[y[chosen] == 0], top)
        toxic = float(y[chosen].sum())
        weight = np.where(y == 1, 0.5 / max(toxic, 1), 0.5 / max(len(chosen) - toxic, 1)).astype(np.float32)
        for rows in np.array_split(rng.permutation(chosen), -(-len(chosen) // WINDOWS_AN_UPDATE)):
            adam.rate = RATE * (1 - 0.8 * min(done / updates, 1))
            used, window = np.unique(found.number[gru.spread(start[rows], length[rows], WINDOW)], return_inverse=True)
            word = np.where(rng.random(len(used)) < LEFT_OUT, 0, found.pieces.word[used])
            here = gru.Pieces(found.pieces.data, found.pieces.start[used], found.pieces.end[used], word)
            _, grad = gru.gradients(net, here, window.reshape(WINDOW, len(rows)), y[rows], weight[rows])
            adam.step(net, grad)
            done += 1
    return net, known


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from the bounded samples of the given labelled rows."""
    nothing = np.zeros(0, dtype=np.uint64)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    known = known.withColumn("h", F.xxhash64("k")).withColumn("curve", F.col("h") % 4 == 0)
    counted = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counted.get(1, 0) + 1) / (counted.get(0, 0) + counted.get(1, 0) + 2)
    unfitted = ToxicityModel(None, nothing, math.log(share / (1 - share)), 0.0, share)
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    texts: list[str] = []
    y: list[int] = []
    start = F.pmod("h", F.greatest(F.length("t") - PASSAGE, F.lit(0)) + 1) + 1
    for value in (0, 1):
        # Ids first, then rows: repeated ids do not raise the bound.
        ids = known.where((F.col("y") == value) & ~F.col("curve")).orderBy("h", "k").limit(TAUGHT)
        passages = rows.join(F.broadcast(ids), "k").select("h", "k", F.substring("t", start.cast("int"), F.lit(PASSAGE)).alias("t"))
        taught = passages.orderBy("h", "k", "t").limit(TAUGHT).select("t").toArrow().column(0).to_pylist()
        texts += taught
        y += [value] * len(taught)
    if len(set(y)) < 2:
        return unfitted
    net, pieces = train(texts, np.array(y))
    ids = known.where("curve").orderBy("h", "k", "y").limit(CURVE)
    scored = rows.join(F.broadcast(ids), "k").select("h", "k", "y", evidence_column(F.col("t"), net, pieces)["evidence"].alias("x")).where("x is not null")
    curve = scored.orderBy("h", "k", "y", "x").limit(CURVE).toArrow()
    x, seen = (curve.column(name).to_numpy().astype(np.float64) for name in ("x", "y"))
    if len(set(seen)) < 2:
        return unfitted
    return ToxicityModel(net, pieces, *logistic(x, seen), share)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds score, predicted (1 if score is at least ``TOXIC``) and window, the piece its highest window starts at."""
    names = ("score", "predicted", "window")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    if model.net is None:
        scored = docs.select(*others, F.lit(model.share).alias("score"), F.lit(None).cast("long").alias("window"))
    else:
        held = docs.select(*others, evidence_column(F.col(f"`{text}`"), model.net, model.known).alias("_found"))
        z = F.lit(model.offset) + F.lit(model.slope) * F.col("_found.evidence")
        score = F.coalesce(1 / (1 + F.exp(-z)), F.lit(model.share))
        scored = held.select(*others, score.alias("score"), F.col("_found.window").alias("window"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def held_out(key: str = "doc_id") -> Column:
    """A fifth of the ids, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels").where(~held_out()))
    scored = with_toxicity(docs.withColumn("held_out", held_out()), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "window")


QUERIES = {"op12_toxicity": (op12_toxicity, None)}
