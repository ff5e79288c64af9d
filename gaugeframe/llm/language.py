"""Language identification by cross-parsing entropy (operator 7).

For every language a suffix automaton is built over a reference of labelled text. A text is
parsed against it into longest matches: a phrase goes on while the reference holds it as a
substring. The language of lowest cost wins. A phrase costs the logarithm of the length of its
own reference (where it is copied from) and ``LENGTH`` for its length, so that references of
different lengths compare. A letter the reference lacks costs a phrase of the longest reference
and the logarithm of the alphabet, in every language alike. The score is the posterior of the
winner at these costs.

The reference of a language is a bounded sample: the documents of smallest hash, at most
``DOCUMENTS`` with one passage of ``PASSAGE`` characters each, cut to ``REFERENCE`` characters
(less if there are so many languages that the automata would exceed ``TOTAL``). No reference is
cut because another one is short. Texts are parsed whole, in pieces of ``PIECE`` letters that go through the automaton side by side.

Null texts and texts without a letter are ``und`` with score 0, and so are all if nothing can
be learned. Ties go to the first language in order. Repeated rows are judged each. An input
column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm.arrowtext import slices
from gaugeframe.llm.data import read

DOCUMENTS = 64
PASSAGE = 4_000
REFERENCE = 40_000
TOTAL = 400_000
PIECE = 256
LENGTH = 1.0
OTHER, SPACE, PAD = 0, 1, 2


@functools.cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Automaton:
    """Suffix automaton of a symbol sequence."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for symbol in symbols:
            here, p = len(self.next), last
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = here
                p = link[p]
            if p >= 0:
                q = self.next[p][symbol]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(symbol) == q:
                        self.next[p][symbol] = clone
                        p = link[p]
                    link[q] = link[here] = clone
            last = here

    def parser(self, alphabet: int) -> np.ndarray:
        """Flat table state * alphabet + symbol -> 2 * next state + (1 if a phrase ends here).

        Where the reference does not go on, the symbol begins the next phrase.
        """
        start = np.zeros(alphabet, dtype=np.int32)
        for symbol, state in self.next[0].items():
            start[symbol] = state
        table = np.broadcast_to(2 * start + 1, (len(self.next), alphabet)).copy()
        for state, ways in enumerate(self.next):
            for symbol, target in ways.items():
                table[state, symbol] = 2 * target
        table[:, PAD] = 2 * np.arange(len(self.next))
        return table.ravel()


class Parser:
    """Phrase counts and costs of texts against the references of all languages."""

    def __init__(self, references: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in references]
        used = sorted({c for _, text in references for c in text if c.isalpha()})
        self.symbol = np.where(letters(), OTHER, SPACE).astype(np.int32)
        self.symbol[[ord(c) for c in used]] = np.arange(3, 3 + len(used))
        self.alphabet = 3 + len(used)
        taught = [self.symbols(text)[0].tolist() for _, text in references]
        self.tables = [Automaton(symbols).parser(self.alphabet) for symbols in taught]
        self.phrase = np.array([math.log(max(2, len(symbols))) + LENGTH for symbols in taught])
        self.missing = self.phrase.max(initial=0.0) + math.log(self.alphabet)

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Letters in lower case as symbols, all between them as one space; and if there is a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        symbol = self.symbol[points]
        keep = np.ones(len(symbol), dtype=bool)
        keep[1:] = (symbol[1:] != SPACE) | (symbol[:-1] != SPACE)
        return symbol[keep], bool((symbol != SPACE).any())

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) costs, and if the text has a letter."""
        counts, missing, has = self._parsed(texts)
        return (counts - missing) * self.phrase + missing * self.missing, has

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts, and if the text has a letter."""
        counts, _, has = self._parsed(texts)
        return counts, has

    def _parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase counts, how many of them are a symbol that the reference lacks, and if the text has a letter."""
        found = [self.symbols(text) for text in texts]
        pieces = np.array([-(-len(s) // PIECE) for s, _ in found])
        lanes = np.full((int(pieces.sum()), PIECE), PAD, dtype=np.int32)
        at = 0
        for (symbol, _), n in zip(found, pieces):
            lanes[at : at + n].reshape(-1)[: len(symbol)] = symbol
            at += n
        steps = np.ascontiguousarray(lanes.T)
        owner = np.repeat(np.arange(len(texts)), pieces)
        counts, missing = np.zeros((2, len(texts), len(self.tables)))
        for i, table in enumerate(self.tables):
            state, ended, lacked = np.zeros((3, len(owner)), dtype=np.int32)
            for symbol in steps:
                state *= self.alphabet
                state += symbol
                code = table[state]
                ended += code & 1
                lacked += code == 1
                state = code >> 1
            counts[:, i] = np.bincount(owner, weights=ended, minlength=len(texts))
            missing[:, i] = np.bincount(owner, weights=lacked, minlength=len(texts))
        return counts, missing, np.array([has for _, has in found], dtype=bool)


@functools.lru_cache(maxsize=2)
def _parser(references: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(references)


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, reference text), ordered by language, from the bounded sample of ``docs``."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    order = Window.partitionBy("l").orderBy("h", "k")
    picked = known.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.xxhash64(key).alias("h"))
    picked = picked.withColumn("row", F.row_number().over(order)).where(F.col("row") <= DOCUMENTS).drop("row").distinct()
    rows = known.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(F.broadcast(picked), ["k", "l"])
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - PASSAGE, F.lit(0)) + 1) + 1
    taught = rows.select("l", "h", "k", F.substring("t", start.cast("int"), F.lit(PASSAGE)).alias("t")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(taught, key=lambda r: (r.l, r.h, r.k, r.t)):
        if any(c.isalpha() for c in row.t) and row.t not in texts.setdefault(row.l, []):
            texts[row.l].append(row.t)
    texts = {name: parts for name, parts in texts.items() if parts}
    joined = {name: " ".join(parts) for name, parts in texts.items()}
    size = min(REFERENCE, TOTAL // max(len(joined), 1))
    return tuple((name, joined[name][:size]) for name in sorted(joined))


def with_language(docs: DataFrame, references: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    @F.arrow_udf("lang_pred string, score double")
    def judged(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in slices(texts):
            values = ["" if v is None else v for v in texts.slice(part.first, len(part)).to_pylist()]
            if not references:
                names += ["und"] * len(values)
                scores += [0.0] * len(values)
                continue
            parser = _parser(references)
            costs, has = parser.costs(values)
            best = costs.argmin(axis=1)
            gap = costs - costs.min(axis=1, keepdims=True)
            posterior = 1 / np.exp(-gap).sum(axis=1)
            names += [parser.names[b] if h else "und" for b, h in zip(best, has)]
            scores += np.where(has, posterior, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["lang_pred", "score"])

    named = docs.withColumn("_judged", judged(F.col(text)))
    return named.withColumns({"lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


def held_out(key: str = "doc_id"):
    """A fifth of the ids, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    references = fit_languages(docs.where(~held_out()))
    return with_language(docs.select("doc_id", "text", held_out().alias("held_out")), references).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language": (op7_language, None)}
