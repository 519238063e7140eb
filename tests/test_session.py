"""Shared storage."""

import types
from pathlib import Path

import pytest

from loomgraph import session as S


def test_only_local_masters_go_without_a_shared_folder():
    for master, local in (("local", True), ("local[4]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://h:7077", False)):
        assert S.is_local(master) is local
    unset = types.SimpleNamespace(get=lambda *a: None)
    session = lambda master, conf: types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getConf=lambda: unset))
    assert S.shared_dir(session("local[2]", unset)).startswith("file://")
    assert S.shared_dir(session("yarn", types.SimpleNamespace(get=lambda *a: "hdfs://x/shared/"))) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(session("yarn", unset))


def test_cut_and_discard(spark):
    df = S.cut(spark.range(5), "numbers")
    folder = Path(df._loomgraph_path.removeprefix("file://")).parent
    assert df.count() == 5 and folder.is_dir()
    S.discard(df)
    assert not folder.exists()
    S.discard(spark.range(1))
