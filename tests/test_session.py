"""Working folders: where they may lie, and when they go."""

from types import SimpleNamespace

import pytest

from talentgrid import session


def test_scratch_tables_go_at_the_end(spark):
    rows = spark.range(5)
    kept = session.settle(rows, "outside")
    with session.scratch(spark):
        gone = session.settle(rows, "inside")
        with session.scratch(spark):
            inner = session.settle(rows, "deeper")
            written = session.settle(inner, "result", keep=True)
        assert gone.count() == 5
        with pytest.raises(Exception):
            spark.read.parquet(inner.inputFiles()[0])
    assert kept.count() == written.count() == 5
    with pytest.raises(Exception):
        gone.count()


@pytest.mark.parametrize("master, warehouse, allowed", [
    ("local[8]", "file:/tmp/w", True), ("local", "/tmp/w", True), ("local-cluster[2,1,1024]", "file:/tmp/w", False),
    ("spark://host:7077", "/tmp/w", False), ("yarn", "hdfs://host/w", True), ("k8s://host", "s3a://b/w", True),
])
def test_local_files_are_no_folder_of_a_cluster(master, warehouse, allowed):
    conf = {"spark.sql.warehouse.dir": warehouse}
    fake = SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *_: None)),
        conf=SimpleNamespace(get=lambda name, *default: conf.get(name, *default)),
    )
    if allowed:
        assert session.shared_folder(fake, "x").startswith(f"{warehouse}/talentgrid-work/x-")
    else:
        with pytest.raises(ValueError):
            session.shared_folder(fake, "x")
