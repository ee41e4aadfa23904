import os
from types import SimpleNamespace

import pytest

from duelframe import runtime
from duelframe.plans import contest_queries as Q


def fake(master, named=None):
    chosen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: chosen[-1] if chosen else None, setCheckpointDir=chosen.append, getConf=lambda: {"spark.checkpoint.dir": named} if named else {})
    return SimpleNamespace(sparkContext=context)


def test_checkpoint_folder():
    assert runtime._checkpoint_dir(fake("spark://a:7077", "hdfs://shared/x")) == "hdfs://shared/x"
    assert os.path.isdir(runtime._checkpoint_dir(fake("local[4]")))
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            runtime._checkpoint_dir(fake(master))


def test_written_tables_follow_each_other(spark):
    store = runtime.Written(spark)
    first = store.keep(spark.range(5), "x")
    assert first.count() == 5
    second = store.keep(first.where("id > 1"), "x")
    other = store.keep(second, "y")
    folder = store.folder.removeprefix("file:")
    assert second.count() == other.count() == 3 and len(os.listdir(folder)) == 2
    store.clear()
    assert not os.path.exists(folder)


def test_parts_for(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [runtime.parts_for(spark, n, 100, 10) for n in (0, 5, 15, 10_000)] == [1, 1, min(cores, 2), 100]


@pytest.mark.parametrize("name", ["power_index", "style_scores", "opponent_strength"])
def test_states_are_derived_once(spark, tiny, name):
    plan = Q.QUERIES[name](spark, tiny)._jdf.queryExecution().simpleString()
    assert plan.count("contest_stats") == 0 and plan.count("combined_data") == 0
