"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gaugeframe.llm import ranked_search
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    """{item: [(doc, score)]} of (doc_id, text) and (item_id, text)."""
    counted = [(doc, Counter(TERM.findall(plain.lower(text)))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall(plain.lower(text)))
    out = {}
    for item, terms in asked.items():
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = []
        for doc, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc, -score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        if scored:
            out[item] = [(doc, -s) for s, _, doc, _ in scored[:k]]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 3)


def test_contract_on_the_smallest_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    rows = ranked_search.op11_ranked_search(spark, SF_DIR).collect()
    assert as_lists(rows) == plain_search(docs, items)


def test_edges(spark, small_blocks):
    docs = [
        (5, "Alpha beta"), (4, "alpha BETA"), (4, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (3, " .,! "),
        (6, "gamma " * 50_000 + "alpha"), (7, "Straße ÄÖ ü"), (8, "x1 2 3"), *[(100 + i, f"filler{i % 7} words alpha") for i in range(40)],
    ]
    items = [(1, "ALPHA alpha beta"), (1, "gamma"), (2, None), (3, ""), (None, "straße x1"), (4, "unknown"), (5, "beta"), (6, "Ü"), (7, "words"), (8, "filler3 alpha")]
    frame = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in docs], "doc_id long, text string, term string, shard int, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    index = ranked_search.build_index(frame)
    assert as_lists(ranked_search.search(index, asked).collect()) == plain_search(docs, items)
    assert as_lists(ranked_search.search(index, asked, k=2).collect()) == plain_search(docs, items, 2)
    assert ranked_search.search(index, asked.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build_index(frame.limit(0)), asked).count() == 0


def test_terms_beyond_the_size_that_is_sent(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(ranked_search, "SENT_PAIRS", 0)
    docs = [(i, f"w{i % 5} w{i % 3} w{i % 11} tail") for i in range(300)]
    items = [(i, f"w{i} w{i + 1} tail") for i in range(12)]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert as_lists(ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()) == plain_search(docs, items)


def packed_lists(rng, n_docs, sizes):
    """Random lists over ``n_docs`` documents as index rows, and the scores of every document."""
    lengths = rng.integers(1, 400, n_docs)
    m = 10 + lengths
    total, lists = np.zeros(n_docs, dtype=np.int64), []
    for size in sizes:
        docs = np.sort(rng.choice(n_docs, size, replace=False)).astype(np.int64)
        tf = rng.geometric(0.4, size).astype(np.int64)
        tf[rng.random(size) < 0.01] = 70_000
        first = docs[:: ranked_search.BLOCK]
        block = np.arange(size) // ranked_search.BLOCK
        w = int(rng.integers(1, 9000))
        row = {
            "df": size, "first": first.astype("<u2").tobytes(), "gap_bytes": 2, "gaps": (docs - first[block]).astype("<u2").tobytes(),
            "tf_bytes": 4, "tfs": tf.astype("<u4").tobytes(), "pair_ends": np.cumsum(np.bincount(block)).astype("<u4").tobytes(),
            "pair_tf": tf.astype("<u4").tobytes(), "pair_n": lengths[docs].astype("<u4").tobytes(),
        }
        lists.append(ranked_search._List(row, w, m, lambda n: 10 + n))
        total[docs] += w * ranked_search.impact(tf, m[docs])
    return lists, total


def test_best_documents_are_exact_and_leave_blocks_packed():
    rng = np.random.default_rng(7)
    packed = blocks = 0
    for _ in range(40):
        lists, total = packed_lists(rng, 20_000, [30, 200, 3_000, 9_000, 15_000])
        docs, scores = ranked_search.best_documents(lists, 20_000, 10)
        best = np.lexsort((np.arange(20_000), -total))[:10]
        assert docs.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
        packed += sum(int((~x.ready).sum()) for x in lists)
        blocks += sum(len(x.ready) for x in lists)
    assert packed > 0.1 * blocks
