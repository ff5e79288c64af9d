"""Periodic runs against a search of every period."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeframe.llm import runs
from gaugeframe.llm.arrowtext import NON_SPACE, slices, words
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"


def smallest_period(w):
    border = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k]
        k += w[i] == w[k]
        border[i + 1] = k
    return len(w) - border[len(w)]


def plain_runs(w, length=6, exponent=4):
    """Every stretch of every period that cannot be extended, if that is its smallest period."""
    ids = {}
    codes = np.array([ids.setdefault(x, len(ids)) for x in w], dtype=np.int64)
    out = []
    for q in range(1, int(len(w) / exponent) + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        for a, b in zip(np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])):
            n = int(b - a) + q
            if n >= max(length, exponent * q) and smallest_period(w[a : a + n]) == q:
                out.append((int(a), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = set()
    for start, length, period in found:
        gone.update(range(start + period, start + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found_in(texts, length=6, exponent=4):
    out = [[] for _ in texts]
    for part in slices(pa.array(texts, type=pa.string())):
        got = words(part, NON_SPACE)
        for row, *run in runs.find_runs(got.hash, got.bounds.astype(np.int64), length, exponent).tolist():
            out[part.first + row].append(tuple(run))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4), st.sampled_from([(6, 4), (1, 2), (6, 3), (9, 2), (4, 4)]))
def test_random_words(texts, bounds):
    assert found_in([" ".join(w) for w in texts], *bounds) == [plain_runs(w, *bounds) for w in texts]


def test_periodic_words():
    rng = random.Random(3)
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            w += (unit * rng.randint(1, 9))[: rng.randint(1, 60)] + [rng.choice("abxyz") for _ in range(rng.randint(0, 4))]
        assert found_in([" ".join(w)]) == [plain_runs(w)]


def test_contract_on_the_smallest_table(spark):
    got = {r.doc_id: r for r in runs.op13_runs(spark, SF_DIR).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    with_any = 0
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        r = got[doc]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == plain.sha("".join("%d,%d,%d\n" % run for run in found).encode())
        assert r.collapsed_sha256 == plain.sha(collapsed(w, found).encode())
        with_any += bool(found)
    assert with_any >= 10


def test_edges(spark):
    long = " ".join(["a"] * 30_000 + [f"w{i}" for i in range(30_000)] + ["x", "y", "z"] * 10_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, "a a a a a a a"), (4, "b a a a a a c"), (4, "b a a a a a c"), (5, long), (6, "ü ü\tü\nü ü ü end")]
    docs = spark.createDataFrame([(i, t, "x", 3, 1) for i, t in texts], "doc_id long, text string, runs string, start int, n_words int")
    rows = runs.with_runs(docs).collect()
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed if r.doc_id != 5 else len(r.collapsed.split())) for r in rows)
    assert got == [
        (0, 7, [(0, 7, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""),
        (4, 7, [], "b a a a a a c"), (4, 7, [], "b a a a a a c"),
        (5, 90_000, [(0, 30_000, 1), (60_000, 30_000, 3)], 30_004), (6, 7, [(0, 6, 1)], "ü end"),
    ]
    assert runs.with_runs(docs.limit(0)).count() == 0 and runs.run_digests(runs.with_repeated_tails(docs).limit(0).transform(runs.with_runs)).count() == 0
    assert runs.run_digests(runs.with_runs(runs.with_repeated_tails(docs))).count() == len(texts)
    assert [r.start for r in rows if r.doc_id == 1] == [3]
    with pytest.raises(ValueError):
        runs.with_runs(docs, exponent=1)


def test_many_runs_of_one_period_behind_different_words():
    w = [x for i in range(4_000) for x in [f"s{i}", *["a", "b"] * 4]]
    assert len(found_in([" ".join(w)])[0]) == 4_000
