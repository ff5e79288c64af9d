from __future__ import annotations

from pathlib import Path

import pytest

from gaugeframe import session


class Settings:
    """Stands in for a session of a cluster or of a plain local run."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_workspace_is_the_folder_the_cluster_names():
    assert session.workspace(Settings("hdfs://shared/run", "yarn")) == "hdfs://shared/run"
    assert session.scratch_path(Settings("hdfs://shared/run/", "yarn"), "x").startswith("hdfs://shared/run/gaugeframe-x-")
    session._written.clear()


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.workspace(Settings(None, "yarn"))


def test_release(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "_written", [])
    monkeypatch.setattr(session, "workspace", lambda _: str(tmp_path))
    kept = session.materialize(spark.range(3), "numbers")
    assert kept.count() == 3
    folders = list(Path(tmp_path).glob("gaugeframe-numbers-*"))
    assert len(folders) == 1
    assert session.release_scratch(spark) == 1 and not folders[0].exists()
