"""Tables in the shared folder: where they lie, and that they go."""

from types import SimpleNamespace

import pytest

from spangrid import session


def test_tables_are_deleted_by_release(spark):
    kept = session.materialise(spark.range(7))
    assert kept.count() == 7
    path = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert session.release() >= 1
    with pytest.raises(FileNotFoundError):
        open(path)
    assert session.release() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    nothing = SimpleNamespace(get=lambda *_: None)
    checkpoint = SimpleNamespace(isDefined=lambda: False)
    jvm = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: checkpoint))
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, _jsc=jvm, master="spark://host:7077"))
    with pytest.raises(ValueError, match="all executors share"):
        session.shared_dir(cluster)


def test_the_named_folder_is_taken():
    named = SimpleNamespace(get=lambda *_: "hdfs:///shared")
    assert session.shared_dir(SimpleNamespace(conf=named)) == "hdfs:///shared"
