import pytest

from tidemark.session import scratch_dir


class Session:
    """A session that only knows its master and settings."""

    def __init__(self, master="local", **conf):
        self.settings, self.master = conf, master
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_is_used_where_it_is_set():
    session = Session(**{"spark.checkpoint.dir": "s3a://shared/folder/"})
    first, second = scratch_dir(session, "x"), scratch_dir(session, "x")
    assert first.startswith("s3a://shared/folder/x-") and first != second


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_local_folder_only_without_setting(master):
    assert "tidemark-" in scratch_dir(Session(master), "x")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    with pytest.raises(ValueError):
        scratch_dir(Session(master), "x")


def test_settings(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"
