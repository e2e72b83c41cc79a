import os

import pytest

from lexmill import session
from lexmill.session import checkpoint, release, stored


def test_release_drops_tables_and_checkpoints(spark):
    table = stored(spark.range(5))
    kept = checkpoint(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert os.path.exists(path) and kept.count() == 3 and any(x.startswith("rdd-") for x in os.listdir(folder))
    assert release(spark) >= 1 and not os.path.exists(path) and not any(x.startswith("rdd-") for x in os.listdir(folder))
    assert release(spark) == 0 and stored(spark.range(2)).count() == 2


def test_tables_go_to_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda s: f"file://{tmp_path}")
    assert session.stored(spark.range(4)).inputFiles()[0].startswith(f"file://{tmp_path}")


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://some:7077"
        _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("N", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Cluster()
        conf = type("Conf", (), {"get": lambda self, *a: None})()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
