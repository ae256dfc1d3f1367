import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from foliate.sources import scratch
from foliate.sources.tables import spread


def session(master, **conf):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda key, *default: conf.get(key.rpartition("spark.")[2], *default)))


def test_the_folder_is_one_that_executors_share():
    assert scratch.scratch_dir(session("spark://host:7077", **{"checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"
    assert scratch.scratch_dir(session("yarn", **{"sql.warehouse.dir": "hdfs://x/warehouse"})) == "hdfs://x/warehouse"
    for local in ("file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.scratch_dir(session("yarn", **{"sql.warehouse.dir": local}))
    assert os.path.isdir(scratch.scratch_dir(session("local[2]")))


def test_tables_made_in_a_block_go_with_it(spark):
    kept = scratch.materialize(spark.range(5), "kept")
    with scratch.scratch_removed(spark):
        made = scratch.materialize(spark.range(3), "made")
        path = made.inputFiles()[0].removeprefix("file://")
        assert made.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 5


def test_only_small_tables_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(2 * cores)
    assert spread(one).rdd.getNumPartitions() == cores and spread(many) is many
    assert sorted(r["id"] for r in spread(one.where(F.col("id") > 50)).collect()) == list(range(51, 100))
