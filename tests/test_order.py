"""Distributed order against plain Python, with small blocks, many partitions and a hot series."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.operators import sequences, splits
from gaugeframe.plans.ordered import dense_index, running_total, series_position
from gaugeframe.plans.quantiles import exact_quantiles, select_ranks


def series(n, seed=0, hot=0.4):
    """(key, t, id, x): one key holds ``hot`` of the rows, times repeat, x is sometimes missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(7)}"
        rows.append((key, rng.randrange(n // 2 + 1), i, None if rng.random() < 0.05 else round(rng.uniform(0, 9), 3)))
    return rows


SCHEMA = "key string, t int, id int, x double"


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_dense_index(spark, partitions):
    rows = series(500)
    got = dense_index(spark.createDataFrame(rows, SCHEMA), ["t", "id"], partitions=partitions)
    assert [r.id for r in got.orderBy("idx").collect()] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert sorted(r.idx for r in got.collect()) == list(range(500))


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.createDataFrame([], SCHEMA), ["t", "id"]).count() == 0


@pytest.mark.parametrize("block", [3, 8, 64, 5000])
def test_sequences_do_not_depend_on_blocks(spark, block):
    rows = sorted(series(300), key=lambda r: (r[1], r[2]))
    indexed = dense_index(spark.createDataFrame(rows, SCHEMA), ["t", "id"], partitions=5)
    made = sequences.make_sequences(indexed, 3, ["x", "id"], target="x", block_rows=block).orderBy("seq").collect()
    want = [([[r[3], float(r[2])] for r in rows[i : i + 3]], rows[i + 3][3]) for i in range(297)]
    assert [(m.X, m.y) for m in made] == want
    trailing = sequences.make_trailing_sequences(indexed, 3, ["id"], block_rows=block).orderBy("idx").collect()
    assert [t.X for t in trailing] == [[[float(r[2])] for r in rows[i - 2 : i + 1]] for i in range(2, 300)]


@settings(max_examples=4, deadline=None)
@given(st.integers(1, 6), st.integers(0, 40), st.integers(0, 10**6))
def test_keyed_sequences(spark, length, n, seed):
    rows = sorted(series(n, seed), key=lambda r: (r[0], r[1], r[2]))
    indexed = dense_index(spark.createDataFrame(rows, SCHEMA), ["key", "t", "id"], partitions=3)
    made = sequences.make_sequences(indexed, length, ["id"], target="x", carry=["id"], keys=["key"], block_rows=max(length, 6))
    got = sorted((m.id, [int(s[0]) for s in m.X]) for m in made.collect())
    want = []
    for key in {r[0] for r in rows}:
        ids = [r[2] for r in rows if r[0] == key]
        want += [(ids[i], ids[i - length : i]) for i in range(length, len(ids))]
    assert got == sorted(want)


def test_block_must_hold_history(spark):
    indexed = dense_index(spark.createDataFrame(series(5), SCHEMA), ["t", "id"])
    with pytest.raises(ValueError, match="block"):
        sequences.make_sequences(indexed, 9, ["x"], target="x", block_rows=4)


def test_series_position(spark):
    rows = sorted(series(400), key=lambda r: (r[0], r[1], r[2]))
    indexed = dense_index(spark.createDataFrame(rows, SCHEMA), ["key", "t", "id"], partitions=6)
    got = {r.id: (r.pos, r.n_rows) for r in series_position(indexed, ["key"], block_rows=16).collect()}
    for key in {r[0] for r in rows}:
        ids = [r[2] for r in rows if r[0] == key]
        assert [got[i] for i in ids] == [(p, len(ids)) for p in range(len(ids))]


def test_running_total(spark):
    rows = sorted(series(400), key=lambda r: (r[0], r[1], r[2]))
    got = running_total(spark.createDataFrame(rows, SCHEMA), ["key"], ["t", "id"], "id", "upto", partitions=6)
    upto = {r.id: r.upto for r in got.collect()}
    for key in {r[0] for r in rows}:
        ids = [r[2] for r in rows if r[0] == key]
        assert [upto[i] for i in ids] == list(np.cumsum(ids))


def test_asof_history(spark):
    rows = sorted(series(200), key=lambda r: (r[1], r[2]))
    frame = spark.createDataFrame([(r[1], r[2]) for r in rows], "t int, id int")
    new, old = frame.where("id % 4 = 0"), frame.where("id % 4 <> 0")
    made = sequences.asof_history(new, old, 4, ["id"], "id", "t", partitions=3)
    got = {r.id: [int(s[0]) for s in r.X] for r in made.collect()}
    want = {}
    for t, i in ((r[1], r[2]) for r in rows if r[2] % 4 == 0):
        past = [r[2] for r in rows if r[2] % 4 and r[1] < t]
        if len(past) >= 3:
            want[i] = past[-3:] + [i]
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_asof_history_over_sparse_partitions(spark, partitions):
    """Partitions without history hand on what they were handed; many new rows may share one history."""
    old = [(t, 1000 + t, None if t == 4 else float(t)) for t in (1, 2, 4, 5, 90, 91)]
    new = [(t, t, -float(t)) for t in range(0, 100)] + [(95, 200 + k, 0.5) for k in range(50)]
    frame = lambda rows: spark.createDataFrame(rows, "t int, id int, x double")
    made = sequences.asof_history(frame(new), frame(old), 4, ["x"], "id", "t", partitions, keep_short=True).collect()
    want = {}
    for t, i, x in new:
        past = [[v] for at, _, v in old if at < t][-3:]
        want[i] = [*past, [x]] if len(past) == 3 else None
    assert {r.id: r.X for r in made} == want and len(made) == len(new)
    assert sequences.asof_history(frame(new), frame([]), 4, ["x"], "id", "t", partitions).count() == 0
    assert sequences.asof_history(frame([]), frame(old), 4, ["x"], "id", "t", partitions).count() == 0


def test_fallback_needs_enough_rows(spark):
    files = spark.createDataFrame([("a.json",), ("b.json",)], "file string")
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "t int, x double")
    made = sequences.fallback_sequences(files, rows, 2, ["x"], ["t"]).collect()
    assert [r.X for r in made] == [[[2.0], [3.0]]] * 2
    assert sequences.fallback_sequences(files, rows, 4, ["x"], ["t"]).count() == 0


def test_pooling_and_names(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 5.0]],)], "X array<array<double>>")
    assert sequences.mean_pool(rows, 2).first().pooled == [2.0, 3.5]
    assert sequences.flatten_sequence(rows).first().flat == [1.0, 2.0, 3.0, 5.0]
    assert sequences.feature_step_names(["a", "b"], 2) == ["a_t-2", "b_t-2", "a_t-1", "b_t-1"]


@pytest.mark.parametrize(("n", "train", "tail"), [(324, 259, 64), (10, 8, 2), (4, 3, 0), (0, 0, 0)])
def test_split_sizes(spark, n, train, tail):
    rows = spark.range(n).withColumnRenamed("id", "seq")
    a, b = splits.split_sequential(rows, 0.8)
    assert (a.count(), b.count()) == (train, n - train)
    assert splits.tail_test(rows, 0.2).count() == tail


def test_validation_tail(spark):
    rows = spark.range(100).withColumnRenamed("id", "seq")
    got = {r["split"]: r["count"] for r in splits.validation_tail(rows).groupBy("split").count().collect()}
    assert got == {"train": 64, "validation": 16, "test": 20}


@pytest.mark.parametrize("ratio", [0.0, 0.25, 0.999, 1.0])
def test_sample_size_is_exact(spark, ratio):
    rows = spark.range(333).select(F.col("id").cast("string").alias("file"))
    kept = splits.sample_exact(rows, "file", ratio, seed=3)
    assert kept.count() == int(333 * ratio)
    again = splits.sample_exact(rows.repartition(7), "file", ratio, seed=3)
    assert sorted(r.file for r in kept.collect()) == sorted(r.file for r in again.collect())


def test_sample_finds_the_edge_elsewhere(spark):
    # Hashes far from even.
    hashes = spark.createDataFrame([(v,) for v in [2**59] * 900 + list(range(100))], "_h long")
    assert splits._edge(hashes, 1000, 50) == (49, 49, 1)
    assert splits._edge(hashes, 1000, 500) == (2**59, 100, 900)


def test_sample_ties_go_by_key(spark, monkeypatch):
    monkeypatch.setattr(splits, "sample_hash", lambda key, seed: F.pmod(key.cast("long"), F.lit(3)) * 2**58)
    rows = spark.range(30).select(F.format_string("%02d", "id").alias("file"))
    kept = sorted(int(r.file) for r in splits.sample_exact(rows, "file", 0.5).collect())
    assert kept == sorted([i for i in range(30) if i % 3 == 0] + [1, 4, 7, 10, 13])


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {
        "wide": rng.lognormal(3, 3, 700), "ties": rng.integers(0, 3, 500).astype(float), "level": np.full(50, 2.5),
        "one": np.array([7.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=31),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("gone", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = exact_quantiles(frame, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}, ["g"], 50)
    table = {r.g: list(r)[1:] for r in got.collect()}
    assert table.keys() == groups.keys()
    for g, vs in groups.items():
        assert table[g] == pytest.approx(list(np.percentile(vs, [0, 25, 50, 90, 100]))), g


def test_select_ranks_reports_rows_below(spark):
    frame = spark.createDataFrame([(v,) for v in [5, 1, 1, 3, 3, 3, 9]], "v long")
    got = select_ranks(frame, "v", {f"r{i}": (i / 6, F.lit(i)) for i in range(8)})
    table = {r.name: (r.value, r.below) for r in got.collect()}
    assert table == {"r0": (1, 0), "r1": (1, 0), "r2": (3, 2), "r3": (3, 2), "r4": (3, 2), "r5": (5, 5), "r6": (9, 6)}


def test_series_without_a_key_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", 4)], "k string, t int")
    got = series_position(dense_index(rows, ["k", "t"]), ["k"]).collect()
    assert sorted((r.k or "", r.t, r.pos, r.n_rows) for r in got) == [("", 1, 0, 2), ("", 3, 1, 2), ("a", 2, 0, 2), ("a", 4, 1, 2)]


def test_quantiles_of_groups_of_any_size(spark):
    """The sketch's cuts must hold both ranks of a quantile, from one value to more than its accuracy."""
    rng = np.random.default_rng(11)
    sizes = [1, 2, 3, 7, 50, 199, 200, 201, 222, 333, 999, 1000, 2500, 25_000]
    rows = [(n, float(v)) for n in sizes for v in (rng.normal(size=n) if n % 2 else rng.integers(0, max(n // 3, 2), n))]
    frame = spark.createDataFrame(rows, "g int, v double").repartition(5)
    for accuracy in (10_000, 100):
        probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99}
        for r in exact_quantiles(frame, "v", probs, ["g"], accuracy, extra=[F.count("v").alias("n")]).collect():
            assert r.n == r.g
            want = np.quantile([v for g, v in rows if g == r.g], list(probs.values()))
            assert [r[name] for name in probs] == pytest.approx(list(want))
