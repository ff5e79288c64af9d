"""The toxicity network: gradients, windows, what it learns, and the contract."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaugeframe.llm import gru, toxicity
from gaugeframe.llm.arrowtext import slices
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"


def test_gradients():
    rng = np.random.default_rng(1)
    net = {name: value.astype(np.float64) for name, value in gru.initial(5, 3).items()}
    net["words"] = rng.standard_normal(net["words"].shape)
    start = np.array([0, 5, 9, 14, 20, 30])
    pieces = gru.Pieces(rng.integers(97, 110, 60).astype(np.uint8), start, start + [5, 4, 5, 6, 10, 4], np.array([1, 0, 2, 3, 0, 5]))
    window, y, weight = rng.integers(0, 6, (7, 9)), rng.integers(0, 2, 9), rng.random(9)
    _, grad = gru.gradients(net, pieces, window, y, weight)
    for name, value in net.items():
        for _ in range(4):
            at = tuple(rng.integers(0, size) for size in value.shape)
            if name == "words" and at[0] == 0:
                continue
            old, step, losses = value[at], 1e-2, []
            for moved in (old + step, old - step):
                value[at] = moved
                losses.append(gru.gradients(net, pieces, window, y, weight)[0])
            value[at] = old
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(float(grad[name][at]), abs=2e-5), name


def plain_logit(net, words):
    """One window, word by word, without any batching."""

    def layer(rows, name):
        hidden = net[f"{name}_state"].shape[3]
        sides = []
        for side, order in ((0, rows), (1, rows[::-1])):
            h, states = np.zeros(hidden), []
            for x in order:
                a = [x @ net[f"{name}_in"][g, side] + net[f"{name}_bias"][g, side] for g in range(3)]
                b = [h @ net[f"{name}_state"][g, side] for g in range(3)]
                z, r = (0.5 + 0.5 * v / (1 + np.abs(v)) for v in (a[0] + b[0], a[1] + b[1]))
                n = a[2] + r * b[2]
                n = n / (1 + np.abs(n))
                h = (1 - z) * n + z * h
                states.append(h)
            sides.append(states if side == 0 else states[::-1])
        states = np.array([np.concatenate(pair) for pair in zip(*sides)])
        seen = states @ net[f"{name}_att"]
        score = (seen / (1 + np.abs(seen))) @ net[f"{name}_ask"]
        share = np.exp(score) / np.exp(score).sum()
        return share @ states

    rows = [np.concatenate([layer([net["bytes"][c] for c in raw], "b"), net["words"][known]]) for raw, known in words]
    return layer(rows, "w") @ net["out"] + net["offset"][0]


def test_scores_are_those_of_the_plain_network():
    rng = np.random.default_rng(2)
    net = gru.initial(3, 5)
    net["words"] = rng.standard_normal(net["words"].shape).astype(np.float32)
    text = " ".join("".join(random.Random(i).choices("abcdé", k=1 + i % 21)) for i in range(75)) + " WORD"
    part = next(slices(pa.array([text])))
    _, distinct = toxicity.tokens(part, np.zeros(0, dtype=np.uint64))
    known = np.sort(distinct[:3])
    found, _ = toxicity.tokens(part, known)
    pieces = [(bytes(found.pieces.data[s:e]), w) for s, e, w in zip(found.pieces.start, found.pieces.end, found.pieces.word)]
    raw = [w.encode()[i : i + toxicity.PIECE] for w in text.lower().split() for i in range(0, len(w.encode()), toxicity.PIECE)]
    assert [pieces[k][0] for k in found.number] == raw
    starts = [*range(0, len(raw) - toxicity.WINDOW, toxicity.STEP), len(raw) - toxicity.WINDOW]
    _, start, length = toxicity.windows(found.bounds)
    assert start.tolist() == starts and set(length) == {toxicity.WINDOW}
    logits = [plain_logit(net, [pieces[k] for k in found.number[s : s + toxicity.WINDOW]]) for s in starts]
    best, place = toxicity.evidence(net, known, part)
    assert best[0] == pytest.approx(max(logits), abs=1e-4) and place[0] == starts[int(np.argmax(logits))]


@pytest.mark.parametrize("size", [0, 1, 31, 32, 33, 48, 49, 1000])
def test_windows_cover_every_piece(size):
    _, start, length = toxicity.windows(np.array([0, size, size]))
    held = set()
    for s, n in zip(start, length):
        held.update(range(s, s + n))
    assert held == set(range(size))


def corpus(n, seed):
    """Texts of invented words; every fifth holds one or two of four bad stems somewhere."""
    rng = random.Random(seed)
    stems = ["gru", "mol", "sen", "tra", "pi", "vo", "ke", "ban"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 200))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 2) if bad else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(["zork", "zorkly", "quix", "quixed"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_learns_on_held_out_texts_and_edges(spark):
    rows = corpus(1_500, 3)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, window int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    more = [*corpus(400, 4), (900, None, 0), (901, "", 0), (902, " !? ", 0), (None, "gru mol", 0), (903, "gru " * 40_000 + "zork quix", 1), (904, "Zork", 1)]
    held = spark.createDataFrame([(i, t, y, "x") for i, t, y in more], "doc_id long, text string, y int, predicted string")
    got = toxicity.with_toxicity(held, model).collect()
    assert len(got) == len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.y for r in got]) >= 0.97
    by_id = {r.doc_id: r for r in got[-6:]}
    assert by_id[900].score == by_id[901].score == by_id[902].score == model.share and by_id[900].window is None
    assert by_id[903].predicted == 1 and by_id[903].window >= 39_960
    assert toxicity.with_toxicity(held.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.selectExpr("doc_id + 100000 as doc_id", "toxic")):
        unfitted = toxicity.fit_toxicity(docs, few)
        assert unfitted.net is None and {r.score for r in toxicity.with_toxicity(held, unfitted).collect()} == {unfitted.share}


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TAUGHT", 20)
    taught = {}
    monkeypatch.setattr(toxicity, "train", lambda texts, y: taught.update(texts=texts, y=y) or (gru.initial(0), np.zeros(0, dtype=np.uint64)))
    rows = [(1, f"bad {i}") for i in range(500)] + [(2 + i, f"good {i}") for i in range(100)]
    labels = [(1, 1)] + [(2 + i, 0) for i in range(100)]
    for key in range(1, 40):
        shifted = spark.createDataFrame([(i * 41 + key, t) for i, t in rows], "doc_id long, text string")
        toxicity.fit_toxicity(shifted, spark.createDataFrame([(i * 41 + key, y) for i, y in labels], "doc_id long, toxic int"))
        if taught:
            break
    assert sorted(np.bincount(taught["y"])) == [20, 20] and len(taught["texts"]) == 40


def test_contract_on_the_smallest_table(spark):
    rows = toxicity.op12_toxicity(spark, SF_DIR).collect()
    docs = duckdb.sql(f"SELECT doc_id FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, in docs)
    assert all(r.held_out == plain.held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
