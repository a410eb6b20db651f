import pytest

from plaudit import session
from plaudit.sources.staging import written


class Settings:
    """Stands for a session with the given settings."""

    def __init__(self, **values):
        self.values, self.conf = {key.replace("__", "."): value for key, value in values.items()}, self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_shared_folder():
    local = {"spark__sql__warehouse__dir": "file:/home/me/spark-warehouse"}
    assert session.shared_folder(Settings(**local, spark__master="local[8]")) == "file:/home/me/spark-warehouse/_scratch"
    assert session.shared_folder(Settings(**local, spark__master="yarn", spark__checkpoint__dir="hdfs:///shared")) == "hdfs:///shared"
    assert session.shared_folder(Settings(spark__sql__warehouse__dir="s3a://bucket/tables", spark__master="yarn")) == "s3a://bucket/tables/_scratch"
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Settings(**local, spark__master=master))


def test_scratch_can_be_removed(spark, tmp_path, monkeypatch):
    """Only the application's own folder goes."""
    monkeypatch.setattr(session, "shared_folder", lambda _: tmp_path.as_uri())
    (tmp_path / "plaudit" / "other").mkdir(parents=True)
    assert written(spark, spark.range(5), "numbers").count() == 5
    assert len(list((tmp_path / "plaudit").iterdir())) == 2
    session.remove_scratch(spark)
    assert [path.name for path in (tmp_path / "plaudit").iterdir()] == ["other"]
