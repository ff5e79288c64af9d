"""Token counts of whole texts by heap-and-linked-list byte-pair merging (operator 3).

The tokenizer is never asked: each distinct pre-token is merged by repeatedly popping its
lowest-ranked adjacent pair from a heap over a doubly linked list of symbols, and its count is
the number of initial symbols less the number of merges. No identifiers are produced.
Counts of pre-tokens are kept per worker in a bounded table.

Nulls and empty texts have 0 tokens. Repeated rows are counted each. Special strings inside a
text are one token each, as the library's default has it. Any text length is counted whole.
An input column that bears the name of an output column is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm.data import read
from gaugeframe.llm.splitting import pretokens, specials

CACHED_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character by which byte-level files write each byte.

    Printable Latin-1 characters stand for themselves, the other bytes in order for the
    characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeCounter(dict):
    """pre-token -> number of tokens, filled on demand and emptied when full."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        self.initial = [vocab[symbol] for symbol in byte_symbols()]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        count = self[word] = self.count(word.encode())
        return count

    def count(self, data: bytes) -> int:
        initial, rules = self.initial, self.rules
        symbols = [initial[b] for b in data]
        size = len(symbols)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []
        for i in range(size - 1):
            rule = rules.get((symbols[i], symbols[i + 1]))
            if rule:
                heap.append((rule[0], i, symbols[i], symbols[i + 1], rule[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue  # a neighbour was merged since
            symbols[i], symbols[j] = joined, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            merges += 1
            h, j = before[i], after[i]
            if h >= 0:
                rule = rules.get((symbols[h], joined))
                if rule:
                    heapq.heappush(heap, (rule[0], h, symbols[h], joined, rule[1]))
            if j < size:
                rule = rules.get((joined, symbols[j]))
                if rule:
                    heapq.heappush(heap, (rule[0], i, joined, symbols[j], rule[1]))
        return size - merges


@functools.cache
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_text(text: str | None, path: str) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    counter, special, total = _counter(path), specials(path), 0
    parts = [text]
    if special is not None and special.search(text):
        parts = special.split(text)
        total = len(parts) - 1
    for part in parts:
        if part:
            total += sum(map(counter.__getitem__, pretokens(part)))
    return total


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (more than ``limit`` tokens) to every row.

    ``path`` is a byte-level BPE file of the tokenizers library that every worker can read
    (default: ``byte_bpe_50k.json`` of the installed public tokenizers).
    """
    file = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([count_text(value.as_py(), file) for value in texts], type=pa.int64())

    return (
        df.withColumn("n_tokens", counted(F.col(text)))
        .withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op3_token_counts": (op3_token_counts, None)}
