"""The shared folder: paths without a scheme belong to the default file system, and tables can be removed."""

from __future__ import annotations

import pytest

from tidemark import shared


class Session:
    """A session on a cluster's master, with or without a checkpoint folder."""

    def __init__(self, spark, folder):
        self._jvm, self._jsc, self.folder = spark._jvm, spark._jsc, folder
        self.sparkContext = self.conf = self
        self.master = "spark://host:7077"

    def get(self, key, default=None):
        return self.folder

    def getCheckpointDir(self):
        return None


def test_qualified_by_the_default_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert shared.qualified(spark, "/ckpt/a") == "file:///ckpt/a"
    assert shared.qualified(spark, "file:///ckpt/a") == "file:///ckpt/a"
    conf.set("fs.viewfs.mounttable.nn.link./ckpt", "file:///tmp")
    try:
        conf.set("fs.defaultFS", "viewfs://nn/")
        assert shared.qualified(spark, "/ckpt/a") == "viewfs://nn/ckpt/a"
        assert shared.shared_folder(Session(spark, "/ckpt")).startswith("viewfs://nn/ckpt/tidemark-")
    finally:
        conf.set("fs.defaultFS", before)


def test_a_cluster_must_name_its_folder(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session(spark, None))


def test_written_tables_are_removed_and_nothing_else(spark, tmp_path):
    folder = shared.shared_folder(spark)
    assert shared.written(spark.range(5), folder).count() == 5
    assert shared.removed(spark, folder) and not shared.removed(spark, folder)
    with pytest.raises(ValueError):
        shared.removed(spark, f"file://{tmp_path}")
    assert tmp_path.exists()
