"""Tables in the shared folder."""

import pytest

from streamspec import storage


class Session:
    """A session that only has settings."""

    def __init__(self, **conf):
        self.conf = self
        self.values = conf

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)

    def set(self, key, value):
        self.values[key.replace(".", "_")] = value


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session(spark_master=master))
        assert storage.shared_dir(Session(spark_master=master, spark_checkpoint_dir="hdfs:///tmp/x/")) == "hdfs:///tmp/x"
    assert storage.shared_dir(Session(spark_master="local[8]")).startswith("file://")


def test_tables_are_discarded_and_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    one, two = (storage.materialise(spark.range(5), n) for n in ("one", "two"))
    assert one.count() == two.count() == 5 and len(list((tmp_path / "streamspec").iterdir())) == 2
    storage.discard(one, None, spark.range(3))
    storage.discard(one)
    assert [p.name.split("-")[0] for p in (tmp_path / "streamspec").iterdir()] == ["two"] and two.count() == 5
    storage.clear(spark)
    assert not (tmp_path / "streamspec").exists()
