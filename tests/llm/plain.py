"""Plain versions of the contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def without_strings(docs, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, hash); ``docs``: ordered (doc_id, text)."""
    seen, out = set(), {}
    for doc, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                gone[i : i + window] = True
            seen.add(piece)
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0
        out[doc] = (len(data), int(gone.sum()), runs, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def without_passages(docs, window=13):
    """doc_id -> (n_words, n_removed, hash)."""
    first, words = {}, {}
    for doc, text in docs:
        words[doc] = w = NON_SPACE.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out[doc] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def contaminated(docs, items, window=10):
    """doc_id -> (n_words, n_hit, n_items, hash of the items, contaminated)."""
    windows = {}
    for item, text in items:
        w = ALPHANUMERIC.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes, out = {len(k) for k in windows}, {}
    for doc, text in docs:
        w = ALPHANUMERIC.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit))
    return out


def near_duplicates(docs, k, percent=80):
    """doc_id -> (n_shingles, component_id), every pair compared."""
    sets = {}
    for doc, text in docs:
        w = NON_SPACE.findall(lower(text))
        sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for doc in sorted(sets):
        shared = Counter(other for s in sets[doc] for other in holders.get(s, ()))
        for other, common in shared.items():
            if 100 * common >= percent * (len(sets[doc]) + len(sets[other]) - common):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
        for s in sets[doc]:
            holders.setdefault(s, []).append(doc)
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}


def held_out(doc, parts, rest):
    return zlib.crc32(str(doc).encode()) % parts == rest
