"""Texts of an Arrow batch as byte arrays, and their words as hash arrays.

Everything here works on slices of at most ``SLICE_BYTES`` of text, so that the arrays of a
task stay small whatever the batch size; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (splitmix64 finaliser); a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def byte_class(excluded: str) -> np.ndarray:
    """256 flags: the bytes that are none of ``excluded`` (Latin-1 characters)."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(excluded.encode("latin-1"), dtype=np.uint8)] = False
    return table


# Words of the contracts. All bytes above 0x7F belong to words, so bytes serve as well as characters.
NON_SPACE = byte_class("\x20\x09\x0a\x0b\x0c\x0d")
ALPHANUMERIC = byte_class("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


class RangeHash:
    """Hashes of any range of a value sequence in constant time each."""

    def __init__(self, values: np.ndarray):
        ahead, self.back = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * ahead[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts(NamedTuple):
    """Consecutive texts: row ``first + i`` holds bytes ``offsets[i]:offsets[i + 1]``."""

    first: int
    bytes: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in slices; a null is an empty text."""
    column = pc.fill_null(column, "") if column.null_count else column
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Words(NamedTuple):
    """Words of a slice: byte ranges, 64-bit hashes, and per text the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(texts: Texts, is_word: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of word bytes in each text."""
    data = LOWER[texts.bytes] if lower else texts.bytes
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(data))]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, RangeHash(BYTE_VALUES[data]).of(start, end), np.searchsorted(start, texts.offsets))
