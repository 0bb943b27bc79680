"""Stored tables with a key: updates touch their own buckets, and commit at once."""

import os

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import keyed
from talentgrid.sources import keyed_table, stores

SCHEMA = "k int, seq int, ok boolean"


def files(folder):
    return {
        os.path.join(d, f) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")
    }


def upsert(stored, batch):
    return keyed.upsert_update(stored, batch, ["k"], [F.desc("seq")])


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, 0, True) for i in range(400)], SCHEMA)
    keyed_table.create(rows, folder, ["k"], 16)
    return folder


def held(spark, folder):
    return {r.k: r.seq for r in keyed_table.read(spark, folder).collect()}


def test_an_update_leaves_other_buckets_alone(spark, table):
    before = files(table)
    assert len({os.path.dirname(f) for f in before}) == 16
    batch = spark.createDataFrame([(7, 1, True), (7, 3, True), (7, 2, True), (9000, 1, True)], SCHEMA)
    assert keyed_table.update(batch, table, upsert) == 1
    want = {i: 0 for i in range(400)} | {7: 3, 9000: 1}
    assert held(spark, table) == want
    after = files(table)
    assert before <= after and len({os.path.dirname(f) for f in after - before}) <= 2
    # What is read: two buckets from the new folder, all others from the old one.
    read = {p for p in keyed_table.read(spark, table).inputFiles()}
    assert len({os.path.dirname(p) for p in read if any(p.endswith(os.path.basename(f)) for f in before)}) >= 14
    found = keyed_table.read_keys(spark, table, spark.createDataFrame([(7,), (-1,)], "k int"))
    assert [tuple(r) for r in found.collect()] == [(7, 3, True)]
    assert len(found.inputFiles()) <= 4
    keyed_table.vacuum(spark, table, 1)
    assert held(spark, table) == want and len(files(table)) < len(after)


def test_a_reader_sees_one_version(spark, table):
    was = keyed_table.read(spark, table)
    keyed_table.update(spark.createDataFrame([(i, 5, True) for i in range(400)], SCHEMA), table, upsert)
    assert {r.seq for r in was.collect()} == {0} and set(held(spark, table).values()) == {5}


def test_of_two_updates_at_once_one_has_to_start_again(spark, table):
    at = keyed_table.current(spark, table)
    one, other = (spark.createDataFrame([(k, 1, True)], SCHEMA) for k in (1, 2))
    keyed_table.update(one, table, upsert, at)
    with pytest.raises(FileExistsError):
        keyed_table.update(other, table, upsert, at)
    assert held(spark, table) == {i: int(i == 1) for i in range(400)}
    keyed_table.update(other, table, upsert)
    assert held(spark, table) == {i: int(i in (1, 2)) for i in range(400)}
    with pytest.raises(FileExistsError):
        keyed_table.create(one, table, ["k"])


def test_an_update_that_dies_changes_nothing(spark, table):
    def failing(stored, batch):
        return upsert(stored, batch).withColumn("seq", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        keyed_table.update(spark.createDataFrame([(1, 1, True)], SCHEMA), table, failing)
    assert held(spark, table) == {i: 0 for i in range(400)}
    keyed_table.vacuum(spark, table, 1)
    assert held(spark, table) == {i: 0 for i in range(400)}


def test_buckets_that_empty_and_tables_without_rows(spark, tmp_path, rows):
    folder = str(tmp_path / "e")
    keyed_table.create(spark.createDataFrame([], SCHEMA), folder, ["k"], 4)
    assert keyed_table.read(spark, folder).collect() == []
    assert keyed_table.update(spark.createDataFrame([], SCHEMA), folder, upsert) == 0

    def last(stored, batch):
        return keyed.upsert_keep_last(stored, batch, ["k"], [F.desc("seq")], "ok")

    keyed_table.update(spark.createDataFrame([(1, 1, True), (2, 1, True), (None, 1, True)], SCHEMA), folder, last)
    keyed_table.update(spark.createDataFrame([(1, 2, False), (2, 2, True)], SCHEMA), folder, last)
    assert rows(keyed_table.read(spark, folder)) == [(2, 2, True), (None, 1, True)]


def test_small_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "a" / "one.json")
    stores.commit_text(spark, path, "é")
    with pytest.raises(FileExistsError):
        stores.commit_text(spark, path, "other")
    assert stores.read_text(spark, path) == "é" and stores.names(spark, str(tmp_path / "a")) == ["one.json"]
    stores.remove(spark, path)
    assert not stores.exists(spark, path) and stores.names(spark, str(tmp_path / "none")) == []
