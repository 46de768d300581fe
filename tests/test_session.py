"""Checkpoint folder rules: the cluster's setting, a scratch folder only in local mode."""

import pytest

from attrition.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, value=None):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default


class _Context:
    def __init__(self, master, current=None, configured=None):
        self.master, self._dir, self._conf = master, current, _Conf(configured)
        self.set_to = None

    def getCheckpointDir(self):
        return self._dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self.set_to = self._dir = path


class _Session:
    def __init__(self, sc):
        self.sparkContext, self.conf = sc, _Conf()


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(_Context("yarn")))


def test_cluster_setting_is_used_and_existing_dir_kept():
    sc = _Context("spark://host:7077", configured="hdfs:///shared/ckpt")
    assert ensure_checkpoint_dir(_Session(sc)) == "hdfs:///shared/ckpt" and sc.set_to == "hdfs:///shared/ckpt"
    kept = _Context("yarn", current="hdfs:///already")
    assert ensure_checkpoint_dir(_Session(kept)) == "hdfs:///already" and kept.set_to is None


def test_local_mode_gets_a_scratch_folder():
    sc = _Context("local[2]")
    path = ensure_checkpoint_dir(_Session(sc))
    assert path and sc.set_to == path
