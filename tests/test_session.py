"""Staging of intermediate tables."""

from types import SimpleNamespace

import pytest

from spotflow import session


def test_tables_are_written_read_and_cleared(spark):
    rows = session.materialize(spark.range(5), "five")
    assert rows.count() == 5 and "five" in rows.inputFiles()[0]


@pytest.mark.parametrize("master,local", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, local):
    made = []
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=made.append, master=master))
    if local:
        assert session.checkpoint_root(fake) == made[0]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_root(fake)
