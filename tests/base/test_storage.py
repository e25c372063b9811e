"""The shared folder."""

import pytest

from berrak.sources import storage


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf, self.master, self.folder, self.applicationId = self, master, folder, f"app-{master}"

    def getConf(self):
        return self

    def get(self, _, default=None):
        return self.folder or default


def test_the_session_names_the_folder():
    assert storage.shared_dir(Session("spark://a:7077", "hdfs:///x")) == "hdfs:///x"


def test_only_a_local_session_gets_a_temporary_folder():
    assert storage.shared_dir(Session("local[4]")) == storage.shared_dir(Session("local[4]"))
    for master in ("spark://a:7077", "yarn", "k8s://a", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(Session(master))
