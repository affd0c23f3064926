from types import SimpleNamespace

import pytest

from partlens import storage


def test_tables_between_stages_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = storage.materialize(spark, spark.range(7), "some")
    assert df.count() == 7 and list((tmp_path / "partlens").iterdir())
    storage.clear(spark)
    assert not (tmp_path / "partlens").exists()


def test_a_cluster_without_a_shared_folder_is_refused():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(cluster)
