import os
from types import SimpleNamespace

import pytest

from casegrain.llm import common


def test_no_local_scratch_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, applicationId="app", master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(SimpleNamespace(sparkContext=context, conf=conf))
    conf = SimpleNamespace(get=lambda key, *a: "hdfs:///shared" if key == "spark.checkpoint.dir" else None)
    assert common.scratch_root(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs:///shared/casegrain-app"


def test_tables_can_be_forgotten(spark):
    table = common.written(spark.range(5), "five")
    other = common.written(spark.range(3), "three")
    path = other.scratch.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    common.forgotten(other)
    assert not os.path.isdir(path) and table.count() == 5
    small, large = common.broadcast_if_small(table), common.broadcast_if_small(table, 1)
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower() and large is table
