"""Work tables and their folder."""

from types import SimpleNamespace

import pytest

from fieldglass import work


def session(master, found=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: found), sparkContext=SimpleNamespace(master=master))


def test_folder():
    assert work.shared_dir(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    one = work.shared_dir(session("local[2]"))
    assert one.startswith("file://") and one == work.shared_dir(session("local[*]"))  # a session's settings stay as they are
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.shared_dir(session("yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.shared_dir(session("local-cluster[3,2,1000]"))


def test_tables_are_written_and_dropped(spark):
    kept = work.written(spark.range(5).selectExpr("id", "cast(null as string) as s"))
    assert kept.count() == 5 and kept.columns == ["id", "s"]
    work.dropped(kept)
    with pytest.raises(Exception):
        kept.collect()
