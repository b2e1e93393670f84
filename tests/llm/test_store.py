"""Intermediate tables: where they are, and when they go."""

from __future__ import annotations

import threading
from types import SimpleNamespace

import pytest

from siltstone.llm import store


def paths(df):
    return df.inputFiles()


def test_a_cluster_needs_a_shared_folder():
    def fake(master, folder=None):
        conf = SimpleNamespace(get=lambda key: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"x-{master}"))

    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            store.shared_root(fake(master))
        assert store.shared_root(fake(master, "hdfs://x/shared/")) == "hdfs://x/shared"
    assert store.shared_root(fake("local[4]")).startswith("file:")


def test_scopes_only_remove_their_own(spark):
    kept, other = [], []
    begun, done = threading.Event(), threading.Event()

    def work():
        with store.scratch() as keep:
            other.append(store.written(spark.range(5), "other"))
            keep.append(other[0])
            begun.set()
            done.wait(60)

    outside = store.written(spark.range(3), "outside")
    thread = threading.Thread(target=work)
    with store.scratch() as keep:
        with store.scratch() as inner:
            kept.append(store.written(spark.range(2), "inner"))
            gone = store.written(spark.range(2), "gone")
            inner.append(kept[0])
        thread.start()
        assert begun.wait(60)
        kept.append(store.written(spark.range(4), "kept"))
        left = store.written(spark.range(4), "left")
        keep.append(kept[1])
    assert kept[1].count() == 4 and outside.count() == 3 and other[0].count() == 5
    done.set()
    thread.join()
    assert other[0].count() == 5
    for df in (gone, left, kept[0]):  # the scope around didn't keep what the inner one did
        with pytest.raises(Exception, match="(?i)not exist|not found|FAILED_READ_FILE"):
            spark.read.parquet(df._written_to).count()


def test_a_failure_within_a_scope_is_passed_on(spark):
    with pytest.raises(ZeroDivisionError), store.scratch():
        1 / 0
    assert store._SCOPE.get() is None
