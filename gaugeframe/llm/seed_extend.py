"""Removal of repeated word passages by seed and extend (operator 6).

Documents are joined on winnowed anchors (word k-grams, one at least in any ``window`` words).
An anchor whose whole context stands in an earlier document is decided at once. Where contexts
differ, matches are extended from the anchor both ways against the earliest document; what
lies beyond the match goes on among the contexts that differ from it in the same way, until
none is left. The kept matches are the maximal repeats of at least ``window`` words.

Nulls, empty texts: no words, nothing removed. Earlier means a smaller doc_id: rows that share
a doc_id, and repeats inside a document, remove nothing. Documents without an id neither lose
words nor take any. Texts of any length are read whole. Hot passages are joined, not gathered,
so that skewed joins are split. Of extra columns only the key is returned.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.anchors import anchor_rows, compared, contexts, covered, extended, numbered, repeated_anchors, unsqueezed, with_spans, word_sequences
from gaugeframe.llm.arrowtext import NON_SPACE, Texts, words
from gaugeframe.llm.data import read

WINDOW = 13
GRAM = 5
ORDER = ("doc",)


def word_values(text: bytes) -> bytes:
    """The hashes of the words of a text."""
    part = Texts(0, np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    return words(part, NON_SPACE).hash.tobytes()


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Word spans (doc, u, start, end) of windows that begin in an earlier document too; ``docs``: doc, u, t."""
    split = compared(repeated_anchors(anchor_rows(docs, word_sequences, k, window)), ORDER)
    spans, rest = split.whole, contexts(docs, split.open, 8, word_values)
    while not rest.isEmpty():
        more, rest = extended(rest, ORDER, 8, window)
        spans = spans.union(more)
    return spans


def kept_words(text: bytes, starts: list[int] | None, ends: list[int] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept ones joined by spaces."""
    found = text.split()  # at the same six bytes as the pattern of words
    if not starts:
        return len(found), 0, b" ".join(found)
    gone = covered(len(found), np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))
    return len(found), int(gone.sum()), b" ".join(compress(found, (~gone).tolist()))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept): every document without the words of earlier passages."""
    source = numbered(docs, key, text)
    held = with_spans(source, repeated_passages(source, window))

    @F.arrow_udf("n_words long, n_removed long, kept binary")
    def clean(z: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        cells = [kept_words(t, a, b) for t, a, b in zip(unsqueezed(z), starts.to_pylist(), ends.to_pylist())]
        columns = list(zip(*cells)) or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["n_words", "n_removed", "kept"])

    done = held.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), clean("z", "starts", "ends").alias("_c"))
    return done.select(key, "_c.n_words", "_c.n_removed", "_c.kept")


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_seed_extend": (op6_seed_extend, None)}
