from __future__ import annotations

import time

import pytest

from shopsight import session


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    stored = session.materialize(spark.range(1000).repartition(3, "id"))
    for _ in range(50):  # files go a little later
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert stored.count() == 1000


def test_setting_is_restored_by_the_last_of_several_writes(spark):
    was = spark.conf.get(session.REMOVE_SHUFFLES)
    with pytest.raises(ZeroDivisionError), session.shuffles_removed(spark):
        with session.shuffles_removed(spark):
            pass
        assert spark.conf.get(session.REMOVE_SHUFFLES) == "true"
        1 / 0
    assert spark.conf.get(session.REMOVE_SHUFFLES) == was
    frames = session.materialize_many({str(i): spark.range(100).repartition(2, "id") for i in range(6)})
    assert [f.count() for f in frames.values()] == [100] * 6
    assert spark.conf.get(session.REMOVE_SHUFFLES) == was
