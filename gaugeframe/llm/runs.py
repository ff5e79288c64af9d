"""Periodic runs of words by maximal-pair enumeration (operator 13).

A maximal pair of a text is two occurrences of one word sequence with different words (or the
text's edge) before and after them. Two occurrences ``d`` words apart of a sequence of ``n >= d``
words cover a stretch of ``n + d`` words of period ``d`` that no neighbouring word extends. The
pairs whose distance keeps ``n >= (exponent - 1) * d`` and ``n + d >= length`` are therefore
exactly the wanted runs, and nothing is extended afterwards.

The suffixes that share enough words to matter are put in order by prefix doubling, and their
LCP-interval tree is walked bottom-up. An interval holds the places of its prefix in order, each
with the class of its left word. When two children meet, each place of the smaller one looks
for places of the larger one within reach and in another class. Places within reach of each
other lie a period apart, so all but the first have the same left word: a list is left at the first
place of the own class, and each place costs a binary search. Multiples of a run's period give
the same stretch, of which the smallest period stays.

Documents are worked on whole, one by one, inside Arrow batches; nothing is shuffled. A null text
has no words, no runs and an empty collapsed text, as has an empty one. A very long text takes
memory in proportion to its words and time in proportion to words times the logarithm of the
longest repeat. Repeated rows are treated each; ties do not arise, since a stretch has one
smallest period. An empty table gives an empty table. An input column that bears the name of
an output column is replaced.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.arrowtext import NON_SPACE, RangeHash, mix, slices, words
from gaugeframe.llm.data import read

LENGTH = 6
EXPONENT = 4
JOIN_WORDS = 1 << 18
_RUNS = "array<struct<start:long,length:long,period:long>>"


def least_match(length: int, exponent: float) -> int:
    """The fewest words a maximal pair of a wanted run has in common."""
    return min(max(math.ceil((exponent - 1) * d), length - d) for d in range(1, max(length, 1) + 1))


def ordered_suffixes(symbols: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """Places of at least ``least`` words in common with another place, in order of their suffixes.

    Symbols of different texts differ; ``end`` is the end of the text a place is in. A group
    keeps the number of its first slot as rank, so places that stand alone need no more work.
    """
    n = len(symbols)
    rank = np.empty(n, dtype=np.int64)
    places = np.argsort(symbols, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = symbols[places][1:] != symbols[places][:-1]
    rank[places] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    known, wanted = 1, None
    while True:
        # Groups of more than one place are refined by the rank of what follows them.
        alone = fresh & np.append(fresh[1:], True)
        places = places[~alone]
        if wanted is None and 2 * known > least:
            wanted = places
        if not len(places):
            break
        after = places + known
        follows = np.where(after < end[places], rank[np.minimum(after, n - 1)], -1) + 1
        old = rank[places]
        order = np.argsort(old * (n + 2) + follows)
        places, old, follows = places[order], old[order], follows[order]
        first = np.ones(len(places), dtype=bool)
        first[1:] = old[1:] != old[:-1]
        fresh = first.copy()
        fresh[1:] |= follows[1:] != follows[:-1]
        slot = np.arange(len(places))
        rank[places] = old + slot[fresh][np.cumsum(fresh) - 1] - slot[first][np.cumsum(first) - 1]
        known *= 2
    wanted = places if wanted is None else wanted
    return wanted[np.argsort(rank[wanted])]


def common_prefixes(hashes: RangeHash, left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``left`` and ``right`` have in common, up to the end of each one's text."""
    shared = np.zeros(len(left), dtype=np.int64)
    most = np.minimum(end[left] - left, end[right] - right)
    for bit in range(int(most.max(initial=0)).bit_length(), -1, -1):
        step = 1 << bit
        rows = np.flatnonzero(shared + step <= most)
        a, b = left[rows] + shared[rows], right[rows] + shared[rows]
        shared[rows[hashes.of(a, a + step) == hashes.of(b, b + step)]] += step
    return shared


def _reachable(places: np.ndarray, lcp: np.ndarray, least: int, exponent: float) -> tuple[np.ndarray, np.ndarray]:
    """Drops places whose nearest occurrence of the first words lies beyond the reach of their longest match."""
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    cluster = np.cumsum(lcp < least)
    order = np.lexsort((places, cluster))
    gap = np.full(len(places) + 1, np.iinfo(np.int64).max)
    same = cluster[order][1:] == cluster[order][:-1]
    gap[1:-1][same] = np.diff(places[order])[same]
    nearest = np.empty(len(places), dtype=np.int64)
    nearest[order] = np.minimum(gap[:-1], gap[1:])
    keep = np.flatnonzero(nearest <= longest // (exponent - 1))
    # What two places have in common is the least of what lies between them.
    between = np.zeros(len(keep), dtype=np.int64)
    if len(keep) > 1:
        between[1:] = np.minimum.reduceat(lcp[: keep[-1] + 1], keep[:-1] + 1)
    return places[keep], between


def maximal_pairs(places: list[int], lcp: list[int], left: list[int], length: int, exponent: float) -> list[tuple[int, int, int]]:
    """(first place, distance, words in common) of the maximal pairs that wanted runs have.

    ``lcp[i]`` is what place ``i`` has in common with the one before; below the least match
    it is 0. ``left`` is the class of the word before each place, by place.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    last = len(places) - 1
    for i, place in enumerate(places):
        ahead = lcp[i + 1] if i < last else 0
        node = [place]
        while stack and stack[-1][0] >= ahead:
            depth, other = stack.pop()
            small, large = (node, other) if len(node) <= len(other) else (other, node)
            reach, low, size = int(depth // (exponent - 1)), length - depth, len(large)
            for x in small:
                own = left[x]
                at = bisect_left(large, x)
                j = at
                while j < size and large[j] - x <= reach and left[large[j]] != own:
                    if large[j] - x >= low:
                        found.append((x, large[j] - x, depth))
                    j += 1
                if at and x - large[at - 1] <= reach:
                    j = bisect_left(large, x - reach, 0, at)
                    while j < at and left[large[j]] != own:
                        if x - large[j] >= low:
                            found.append((large[j], x - large[j], depth))
                        j += 1
            if len(small) * 8 < size:
                for x in small:
                    insort(large, x)
            else:
                large += small
                large.sort()
            node = large
        if ahead:
            stack.append((ahead, node))
    return found


def find_runs(word_hash: np.ndarray, bounds: np.ndarray, length: int = LENGTH, exponent: float = EXPONENT) -> np.ndarray:
    """Rows (text, start, length, period) in that order of the runs of each text of a slice."""
    none = np.zeros((0, 4), dtype=np.int64)
    n = len(word_hash)
    if not n:
        return none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][text].astype(np.int64)
    symbols = mix(word_hash + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = least_match(length, exponent)
    places = ordered_suffixes(symbols, end, least)
    if len(places) < 2:
        return none
    lcp = np.zeros(len(places), dtype=np.int64)
    lcp[1:] = common_prefixes(RangeHash(symbols), places[:-1], places[1:], end)
    lcp[lcp < least] = 0
    places, lcp = _reachable(places, lcp, least, exponent)
    if len(places) < 2:
        return none
    left = np.empty(n, dtype=np.int64)
    left[1:] = symbols[:-1].view(np.int64)
    # The edge of a text is a class of its own; no word of this text has the number of another text's word.
    starts = bounds[:-1][np.diff(bounds) > 0]
    left[starts] = 0
    pairs = np.array(maximal_pairs(places.tolist(), lcp.tolist(), left.tolist(), length, exponent), dtype=np.int64).reshape(-1, 3)
    if not len(pairs):
        return none
    start, period = pairs[:, 0], pairs[:, 1]
    stretch = pairs[:, 2] + period
    order = np.lexsort((period, stretch, start))
    start, stretch, period = start[order], stretch[order], period[order]
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (stretch[1:] != stretch[:-1])
    start, stretch, period = start[smallest], stretch[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, stretch, period = start[order], stretch[order], period[order]
    return np.column_stack([text[start], start - bounds[:-1][text[start]], stretch, period])


def kept_words(bounds: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    edges = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
    base = bounds[:-1][runs[:, 0]] + runs[:, 1]
    np.add.at(edges, base + runs[:, 3], 1)
    np.add.at(edges, base + runs[:, 2], -1)
    return np.cumsum(edges[:-1]) == 0


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words of each text joined by one space: the bytes of all texts and the texts' offsets in them."""
    size = end - start + 1
    offsets = np.append(0, np.cumsum(size))
    data = np.append(data, np.uint8(32))
    parts = []
    for first in range(0, len(start), JOIN_WORDS):
        s, z = start[first : first + JOIN_WORDS], size[first : first + JOIN_WORDS]
        stops = np.cumsum(z)
        part = data[np.repeat(s - stops + z, z) + np.arange(stops[-1])]
        part[stops - 1] = 32
        parts.append(part)
    # The space after the last word of a text goes.
    text = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    last = bounds[1:][np.diff(bounds) > 0] - 1
    text = np.delete(text, offsets[last + 1] - 1)
    gone = np.append(0, np.cumsum(np.diff(bounds) > 0))
    return text.tobytes(), offsets[bounds] - gone


def runs_of_batch(texts: pa.Array, length: int, exponent: float) -> pa.StructArray:
    counts, listed, at, parts, places = [], [], [np.zeros(1, dtype=np.int64)], [], [np.zeros(1, dtype=np.int64)]
    for part in slices(texts):
        found = words(part, NON_SPACE)
        bounds = found.bounds.astype(np.int64)
        runs = find_runs(found.hash, bounds, length, exponent)
        keep = kept_words(bounds, runs)
        kept = np.append(0, np.cumsum(keep))[bounds]
        text, offsets = joined(part.bytes, found.start[keep], found.end[keep], kept)
        counts.append(np.diff(bounds))
        at.append(np.searchsorted(runs[:, 0], np.arange(1, len(part) + 1)) + at[-1][-1])
        listed.append(runs)
        places.append(offsets[1:] + places[-1][-1])
        parts.append(text)
    runs = np.concatenate(listed) if listed else np.zeros((0, 4), dtype=np.int64)
    items = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    buffers = [None, pa.py_buffer(np.concatenate(places)), pa.py_buffer(b"".join(parts))]
    return pa.StructArray.from_arrays(
        [
            pa.array(np.concatenate(counts) if counts else [], type=pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.concatenate(at), type=pa.int32()), items),
            pa.Array.from_buffers(pa.large_string(), len(texts), buffers).cast(pa.string()),
        ],
        ["n_words", "runs", "collapsed"],
    )


def with_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, exponent: float = EXPONENT) -> DataFrame:
    """Adds n_words, runs and collapsed.

    ``runs`` lists (start, length, period) of every stretch of at least ``length`` words and
    ``exponent`` (2 or more) times its smallest period, by start, then period. ``collapsed``
    is the text without the words that a run repeats, joined by one space.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")

    @F.arrow_udf(f"struct<n_words:long,runs:{_RUNS},collapsed:string>")
    def found(texts: pa.Array) -> pa.Array:
        return runs_of_batch(texts, length, exponent)

    names = ("n_words", "runs", "collapsed")
    others = [c for c in docs.columns if c not in names]
    held = docs.select(*[F.col(f"`{c}`") for c in others], found(F.col(f"`{text}`")).alias("_found"))
    return held.select(*[F.col(f"`{c}`") for c in others], *[F.col(f"_found.{c}").alias(c) for c in names])


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of the contract: of one key in ten, the words from a place on repeat with a period drawn by the key."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), tail), F.lit(1), n), " ")

    found = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The lambda holds the words once for all its uses.
    changed = F.get(F.transform(F.array(found), repeated), 0)
    return docs.withColumn(text, F.when(h % 10 == 0, changed).otherwise(F.col(text)))


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``runs`` and ``collapsed``."""
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda top, r: F.when(top.isNull() | (r.length * top.period > top.length * r.period), r).otherwise(top),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(with_runs(with_repeated_tails(docs)))


QUERIES = {"op13_runs": (op13_runs, None)}
