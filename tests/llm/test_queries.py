"""The registered queries on the smallest tables against plain versions."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gaugeframe.llm import quality
from gaugeframe.llm.queries import QUERIES
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"


def table(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF_DIR}/{name}.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id, text")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def run(spark, name):
    return QUERIES[name][0](spark, SF_DIR).collect()


def check_packing(rows, texts, library):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in sequences.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= total / 2048 * 1.02 + 1


def test_packing(spark, docs, library):
    check_packing(run(spark, "op1_packing"), dict(docs), library)


def test_token_counts(spark, docs, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op3_token_counts")}
    for doc, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc] == (len((text or "").encode()), n, n > 512)


def test_neighbours(spark):
    rows = run(spark, "op2_neighbours")
    vectors = {i: np.array(v, dtype=float) for i, v in table("embeddings", "vec_id, embedding")}
    ids = np.array(sorted(vectors))
    all_vectors = np.stack([vectors[i] for i in ids])
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for query, listed in found.items():
        listed.sort(key=lambda r: r.rank)
        assert [r.rank for r in listed] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in listed] == sorted((-r.score, r.vec_id) for r in listed)
        score = all_vectors @ vectors[query]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != query][:20]
        hits += len(set(best) & {r.vec_id for r in listed})
    assert hits >= 0.9 * 20 * len(found)


def test_quality_on_held_out_labels(spark):
    labels = {doc: q for doc, q, _ in table("labels")}
    rows = run(spark, "op4_quality")
    assert len(rows) == 200
    assert all(r.held_out == plain.held_out(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    right = [r.predicted == labels[r.doc_id] for r in rows if r.doc_id in labels]
    assert np.mean(right) >= 0.85


def test_languages_on_held_out_documents(spark):
    lang = dict(table("documents", "doc_id, lang"))
    rows = run(spark, "op7_language")
    assert len(rows) == 200 and all(r.held_out == plain.held_out(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) >= 0.95


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op5_suffix_dedup")}
    assert got == plain.without_strings(docs)


def test_seed_extend(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op6_seed_extend")}
    assert got == plain.without_passages(docs)


def test_decontamination(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, "op8_decontaminate")}
    want = plain.contaminated(docs, table("benchmark"))
    assert got == want and any(v[-1] for v in want.values())


def test_near_dedup(spark, docs):
    rows = run(spark, "op9_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain.near_duplicates(docs, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_secrets(spark, docs):
    import re

    got = {(r.doc_id, r.start, r.length) for r in run(spark, "op10_secrets")}
    want = {(doc, m.start(1), 40) for doc, text in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', text or "")}
    assert got == want


def test_planted_secrets_at_scale(spark):
    """Every planted token of sf0.1, also those after words like example.com."""
    import re

    import __spark_entry__

    sf_dir = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text ilike '%token = %'").select("doc_id", "text").collect()
    want = {(r.doc_id, m.start(1), 40) for r in texts for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    got = {(r.doc_id, r.start, r.length) for r in __spark_entry__.queries()["op10_secrets"](spark, sf_dir).collect()}
    assert got == want and {1110, 7273} <= {doc for doc, _, _ in got}


def test_pipeline(spark, library, docs):
    """Each stage on what the stage before it kept, against the plain version."""
    texts, state = dict(docs), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = quality.fit_quality(state, spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~quality.held_out()))
    accepted = {r.doc_id for r in quality.with_quality(state, first).where("predicted = 1").collect()}
    columns = state.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.collect()} if name != "packing" else before
        state = stage(spark, state, SF_DIR)
        if name == "packing":
            check_packing(state.collect(), before, library)
            continue
        assert state.columns == columns
        rows = state.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        after = {r.doc_id: r.text for r in rows}
        if name == "quality":
            assert set(after) == accepted
        elif name == "near_duplicates":
            found = plain.near_duplicates(sorted(before.items()), 5)
            assert set(after) == {doc for doc, (_, root) in found.items() if doc == root}
        elif name == "decontamination":
            hit = plain.contaminated(sorted(before.items()), table("benchmark"))
            assert set(after) == {doc for doc, v in hit.items() if not v[-1]}
        else:
            assert set(after) == set(before) and not any('token = "' in (t or "") and "[SECRET]" not in t for t in after.values())
            assert all(after[d] == before[d] or before[d].startswith(after[d].split("[SECRET]")[0]) for d in after)
        if name != "quality":
            assert all(texts[d] == after[d] for d in after if "[SECRET]" not in (after[d] or ""))
        before = after
        state = spark.createDataFrame(rows, state.schema)
