"""The checkpoint folder: the cluster's setting is used as is; unset on a
cluster is an error (never a machine-local folder); a local session without
it gets a scratch folder."""

import pytest

from ledgerlens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _Ctx:
    def __init__(self):
        self.dirs = []

    def setCheckpointDir(self, d):  # noqa: N802 -- Spark's name
        self.dirs.append(d)


class _Session:
    def __init__(self, **conf):
        self.conf = _Conf(conf)
        self.sparkContext = _Ctx()


def test_configured_folder_is_used():
    s = _Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.dirs == ["hdfs:///shared/ckpt"]


def test_unset_on_a_cluster_is_an_error():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session(**{"spark.master": "k8s://https://cluster"}))


def test_local_session_gets_a_scratch_folder():
    s = _Session(**{"spark.master": "local[4]"})
    d = ensure_checkpoint_dir(s)
    assert d and s.conf.get("spark.checkpoint.dir") == d and s.sparkContext.dirs == [d]
