"""The shared folder is the one the session names; a local one will do only where all of Spark is local."""

from types import SimpleNamespace

import pytest

from colloquy.sources.shared import shared_folder


def session(master, setting=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda x: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=context)


def test_setting_comes_first():
    assert shared_folder(session("spark://x:1", "hdfs://a/b/", "/c")) == "hdfs://a/b"
    assert shared_folder(session("spark://x:1", None, "/c")) == "/c"


@pytest.mark.parametrize("master", ["spark://x:1", "yarn", "local-cluster[3,2,1000]", "k8s://x"])
def test_cluster_without_setting_is_refused(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]", "local[2,3]"])
def test_local_session_has_its_own(master):
    assert "colloquy-" in shared_folder(session(master))
