"""Window files on disk, with the defects the readers must cope with."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import clean, features
from gaugeframe.sources import reports, sinks
from gaugeframe.sources import windows as w

METRICS = ("throughput", "packets_lost", "packet_loss_rate", "jitter", "speed")
FIRST = [(1276.6, 0.0, 0.0, 17.548, 0), (605.2, 1.0, 0.8, 20.321, 0), (1527.1, 2.0, 0.6, 15.194, 0),
         (1404.2, 2.0, 0.7, 15.79, 0), (974.0, 0.0, 0.0, 22.803, 0)]


def document(stamp, rows, qoe=71.5328, keys=None):
    keys = keys or [str(int(stamp) - 2 * (len(rows) - 1 - i)) for i in range(len(rows))]
    return {"QoE": qoe, "timestamp": stamp, **{k: dict(zip(METRICS, r)) for k, r in zip(keys, rows)}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("windows")
    four = FIRST[:4]
    docs = {
        "20250402121954.json": document(20250402121954, FIRST),
        # Keys made by integer subtraction have seconds above 59.
        "20250402122100.json": document(20250402122100, FIRST),
        "20250402122200.json": document("20250402122200", list(reversed(FIRST)), qoe=None,
                                        keys=[f"2025040212220{i}" for i in (4, 3, 2, 1, 0)]),
        "20250402122300.json": document(20250402122300, four),
    }
    texts = {name: json.dumps(d, indent=4) for name, d in docs.items()}
    quoted = document(20250402122400, FIRST)
    for i, entry in enumerate(v for k, v in quoted.items() if k not in ("QoE", "timestamp")):
        entry["speed"] = ["050", "+7", "-3", "fast", 20][i]
    texts["20250402122400.json"] = json.dumps(quoted)
    gap = document(20250402122500, FIRST)
    del gap[[k for k in gap if k not in ("QoE", "timestamp")][2]]["jitter"]
    texts["20250402122500.json"] = json.dumps(gap)
    gap = document(20250402122600, FIRST)
    del gap[[k for k in gap if k not in ("QoE", "timestamp")][0]]["jitter"]
    gap["note"] = "not an object"
    texts["20250402122600.json"] = json.dumps(gap)
    texts["20250402122700.json"] = json.dumps({"QoE": 1.0, "timestamp": 20250402122700})
    texts["20250402122800.json"] = json.dumps({"timestamp": 20250402122800, "1": dict(zip(METRICS, FIRST[0]))})
    texts["20250402122900.json"] = '{"QoE": 3, '
    texts["readme.txt"] = "not a window"
    for name, body in texts.items():
        (path / name).write_text(body)
    return path


def by_file(df):
    return {r["file"]: r for r in df.collect()}


def test_scan_keeps_json_files_only(spark, folder):
    assert w.scan_documents(spark, str(folder)).count() == 10


def test_scan_windows(spark, folder):
    rows = by_file(w.scan_windows(spark, str(folder)))
    first = rows["20250402121954.json"]
    assert first["QoE"] == 71.5328 and first["ts_raw"] == "20250402121954"
    assert [tuple(s["v"]) for s in first["samples"]] == [tuple(map(float, r)) for r in FIRST]
    assert [s["key"] for s in rows["20250402122100.json"]["samples"]][0] == "20250402122092"
    # Sub-samples are ordered by key, not by their place in the document.
    assert [s["v"]["throughput"] for s in rows["20250402122200.json"]["samples"]] == [r[0] for r in FIRST]
    assert rows["20250402122200.json"]["QoE"] is None
    assert rows["20250402122900.json"]["samples"] is None


def test_unusual_documents(spark):
    texts = [
        '{"QoE":"71.5","timestamp":"20250101","b":{"throughput":"fast","speed":"050","jitter":1e-3},"a":{"speed":5},"n":"x","m":[1],"z":null}',
        '{"QoE":NaN,"timestamp":20250402121954,"a":{"speed":5,"jitter":NaN}}',
        '{"QoE":1,"a":{"speed":1},"QoE":2}',
        "[1, 2]",
        '{"QoE": 1',
        None,
    ]
    got = w.to_windows(spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, value string")).orderBy("i").collect()
    empty = (None,) * 5
    assert (got[0].QoE, got[0].ts_raw, got[0].ts) == (71.5, "20250101", None)
    assert [(s.key, tuple(s.v)) for s in got[0].samples] == [("a", (*empty[:4], 5.0)), ("b", (None, None, None, 0.001, 50.0))]
    assert (got[1].QoE, got[1].ts_raw) == (None, "20250402121954")
    assert [tuple(s.v) for s in got[1].samples] == [(None, None, None, None, 5.0)]
    assert len(got[2].samples) == 1
    assert all(g.samples is None and g.QoE is None for g in got[3:])


def test_flatten_and_stats(spark, folder):
    frame = features.window_stats(features.flatten_samples(w.scan_windows(spark, str(folder))))
    rows = by_file(frame)
    first = rows["20250402121954.json"]
    assert [first[f"f{i}"] for i in (0, 1, 2, 3, 4, 20, 23)] == [1276.6, 0, 0, 17.548, 0, 974.0, 22.803]
    jitter = np.array([r[3] for r in FIRST])
    assert first["jitter_mean"] == pytest.approx(18.3312) and first["jitter_std"] == pytest.approx(np.std(jitter), abs=1e-12)
    assert (first["jitter_min"], first["jitter_max"]) == (15.194, 22.803)
    assert rows["20250402122300.json"]["f20"] is None
    assert rows["20250402122500.json"]["f13"] is None
    assert rows["20250402122700.json"]["jitter_mean"] is None
    assert len([c for c in frame.columns if c.startswith("f") and c[1:].isdigit()]) == 25


def test_long_windows_are_not_cut(spark, folder):
    with pytest.raises(Exception, match="more than 3 sub-samples"):
        features.flatten_samples(w.scan_windows(spark, str(folder)), n_samples=3).select("f0").collect()


def test_legacy_layout(spark, folder):
    frame = features.flatten_samples(w.scan_windows_legacy(spark, str(folder)), "legacy")
    first = by_file(frame)["20250402121954.json"]
    assert [first[f"f{i}"] for i in range(4)] == [0.0, 17.548, 1276.6, 0.0]
    assert "f19" in frame.columns and "f20" not in frame.columns


def test_collapsed_windows(spark, folder):
    rows = by_file(w.scan_windows_mean(spark, str(folder)))
    mean = lambda i: round(float(np.mean([r[i] for r in FIRST])), 2)
    first = rows["20250402121954.json"]
    assert [first[m] for m in ("packet_loss_rate", "jitter", "throughput", "speed")] == [mean(2), mean(3), mean(0), mean(4)]
    assert rows["20250402122600.json"]["jitter"] == round(float(np.mean([r[3] for r in FIRST[1:]])), 2)
    assert rows["20250402122700.json"]["jitter"] is None


def test_valid_windows(spark, folder):
    docs = w.with_document(w.scan_documents(spark, str(folder)))
    valid = {r.file for r in clean.valid_window(docs).collect()}
    # Only the first sub-sample is looked at, so 122500 passes and 122600 does not.
    assert valid == {f"2025040212{s}.json" for s in ("1954", "2100", "2300", "2400", "2500")}
    assert tuple(clean.validity_counts(docs).first()) == (5, 5)
    legacy = {r.file for r in clean.valid_window(docs, "legacy").collect()}
    assert legacy - valid == {"20250402122600.json", "20250402122700.json"}


def test_repair(spark, folder):
    fixed = clean.repair_types(w.scan_documents(spark, str(folder)))
    row = by_file(fixed)["20250402122400.json"]
    speeds = [v["speed"] for k, v in json.loads(row["value"]).items() if k not in ("QoE", "timestamp")]
    assert speeds == [50, 7, -3, "fast", 20]
    assert (row["modified"], row["unparsable"]) == (True, 1)
    assert tuple(clean.repair_counts(fixed).first()) == (10, 1, 1)


def test_written_windows_read_back(spark, folder, tmp_path):
    docs = clean.valid_window(w.with_document(w.scan_documents(spark, str(folder))))
    rows = w.to_windows(docs)
    sinks.sink_windows_json(rows, str(tmp_path / "lines"))
    sinks.sink_windows_json(rows, str(tmp_path / "files"), per_window=True)
    back = w.scan_windows(spark, str(tmp_path / "lines"), one_per_line=True)
    plain = lambda df: sorted((r.ts_raw, r.QoE, str(r.samples)) for r in df.collect())
    assert plain(back) == plain(rows)
    # A window keeps the file name its time gives, so that it matches its row again.
    assert all(r.file == (f"{ts}.json" if (ts := r.ts and r.ts.strftime("%Y%m%d%H%M%S")) else r.file) for r in back.collect())
    assert len(list((tmp_path / "files").glob("window=*"))) == 5


def test_validation_pair(spark, folder, tmp_path):
    rows = w.to_windows(clean.valid_window(w.with_document(w.scan_documents(spark, str(folder)))))
    sinks.sink_validation_pair(rows, str(tmp_path / "v"))
    truth, masked, metadata = sinks.load_validation_pair(spark, str(tmp_path / "v"))
    assert masked.where("QoE IS NOT NULL").count() == 0 and masked.count() == truth.count() == 5
    assert by_file(metadata)["20250402121954.json"]["ground_truth_qoe"] == 71.5328
    stated = reports.scan_validation_metadata(spark, str(tmp_path / "v" / "validation_metadata"))
    assert stated.count() == metadata.count() and {r.format for r in stated.collect()} == {"new"}


def test_validation_metadata_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MANIFEST_FILES", 4)
    rows = spark.createDataFrame([(f"{i}.json", float(i)) for i in range(11)] + [("3.json", 30.0), ("none.json", None)], "file string, QoE double")
    sinks.sink_validation_pair(rows, str(tmp_path / "v"), "20250101000000", "legacy", 0.5, 9)
    _, _, metadata = sinks.load_validation_pair(spark, str(tmp_path / "v"))
    assert {r.file: r.ground_truth_qoe for r in metadata.collect()} == {f"{i}.json": 30.0 if i == 3 else float(i) for i in range(11)}
    documents = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "v" / "validation_metadata")).collect()]
    assert 1 < len(documents) <= 4
    for d in documents:
        assert (d["creation_timestamp"], d["format"], d["sample_ratio"], d["random_seed"]) == ("20250101000000", "legacy", 0.5, 9)


def test_disk_usage(spark, folder):
    row = sinks.dataset_disk_usage(spark, str(folder)).first()
    sizes = [p.stat().st_size for p in folder.glob("*.json")]
    assert (row.n_files, row.total_bytes) == (len(sizes), sum(sizes))


def test_flat_records(spark, tmp_path):
    record = {"packet_loss_rate": 9.9, "jitter": 0.194, "throughput": 104.94, "speed": "49.82", "QoE": None, "timestamp": "20250204123000"}
    (tmp_path / "a.json").write_text(json.dumps(record, indent=4))
    (tmp_path / "b.json").write_text(json.dumps({**record, "timestamp": 20250205070100, "hour": 23, "QoE": 5}))
    rows = by_file(w.scan_flat(spark, str(tmp_path)))
    a, b = rows["a.json"], rows["b.json"]
    assert (a.speed, a.QoE, a.hour, a.minute, a.day_of_week) == (49.82, None, 12, 30, 1)
    assert (b.QoE, b.hour, b.minute, b.day_of_week) == (5.0, 23, 1, 2)
    assert w.scan_inference_record(spark, str(tmp_path)).columns[2:] == ["packet_loss_rate", "jitter", "throughput", "speed"]


def test_mask_keeps_truth(spark):
    rows = clean.mask_target(spark.createDataFrame([(1.0,)], "QoE double"))
    assert tuple(rows.select("QoE", "QoE_truth").first()) == (None, 1.0)


def test_select_features(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "file string, f0 double, f1 double, QoE double")
    assert features.select_features(rows).columns == ["f0", "f1", "QoE"]
    assert features.select_features(rows, ["f1"]).columns == ["f1", "QoE"]
    assert features.temporal_fields(rows.select(F.lit("2025-04-02 08:15:00").cast("timestamp").alias("ts"))).first()[1:] == (8, 15, 2)
