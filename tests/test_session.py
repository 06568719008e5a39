"""The shared checkpoint folder."""

import pytest

from basketlens.session import ensure_checkpoint_dir, runs_on_one_machine


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class Session:
    def __init__(self, master, conf=None):
        self.sparkContext, self.settings = Context(master), conf or {}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session(master))


def test_the_named_folder_is_used_and_a_local_session_gets_its_own():
    assert ensure_checkpoint_dir(Session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})) == "hdfs:///shared"
    assert runs_on_one_machine("local[4]") and ensure_checkpoint_dir(Session("local[4]"))


def test_labels_keep_plain_digits():
    from basketlens.params import default_params

    p = default_params().with_(threshold=1_000_000.0, band_edges=(50.0, 1_000_000.0, 1_250_000.0))
    assert p.at_or_above_label == "At/Above $1000000"
    assert p.band_labels == ["<$50", "$50-$999999", "$1000000-$1249999", "$1250000+"]
    assert p.with_(threshold=99.5).below_label == "Below $99.5"
    assert default_params().near_band_label == "$75-$99"
