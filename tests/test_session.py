from __future__ import annotations

from types import SimpleNamespace

import pytest

from tallyweave.session import work_root


def _session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_root(_session(master))
    assert work_root(_session(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_may_use_its_own(spark):
    assert work_root(spark)


def test_scratch(spark):
    """What is written inside goes at the end; what is kept stays, and goes with the scope around it."""
    import os

    from tallyweave import session as S

    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file:"))
    with S.scratch(spark):
        with S.scratch(spark):
            a = S.materialize(spark.range(10).repartition(3), "a")
            b = S.kept(a.groupBy((a.id % 2).alias("k")).count(), "b")
            files = a.inputFiles(), b.inputFiles()
        assert not os.path.exists(files[0][0].removeprefix("file:")) and there(b)
        assert sorted(tuple(r) for r in b.collect()) == [(0, 5), (1, 5)]
    assert not os.path.exists(files[1][0].removeprefix("file:"))
    try:
        with S.scratch(spark):
            files = S.materialize(spark.range(3), "c").inputFiles()
            raise KeyError
    except KeyError:
        pass
    assert not os.path.exists(files[0].removeprefix("file:"))
    assert spark.conf.get(S._SHUFFLE_CLEANUP) == "false"


def test_partitions_bound_what_a_task_holds(spark):
    """Partitions follow a few megabytes of shuffle, and small tables are split for all cores."""
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "1m"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "32m"
