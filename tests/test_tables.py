"""CSV tables: records on one line, large files in many tasks, and rows that don't fit."""

import pytest

from talentgrid.sources import tables

SCHEMA = "id int, text string, n double"
TEXTS = [
    "plain", "", None, 'a "quoted" word', "two\nlines", "back\\slash", "\\n is no break", "\\\\n\n\\", "a,b",
    "\r\n end", "\x1b[0m\x1bn\n\x1b", " blanks ", "ends in \\", 'mix "\n,\\n\\\\\n"', "été 中文 😀",
]


def test_texts_come_back(spark, tmp_path):
    rows = [(i, t, i / 2) for i, t in enumerate(TEXTS)]
    tables.write_csv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"))
    rows = [(i, t or None, n) for i, t, n in rows]
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "t"), SCHEMA).collect())) == rows
    good, rejected = tables.read_csv_with_rejects(spark, str(tmp_path / "t"), SCHEMA)
    assert sorted(map(tuple, good.collect())) == rows and rejected.collect() == []


def test_a_large_file_is_read_in_several_tasks(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "CAST(id AS int) AS id", "concat('first \"', id, '\"\nsecond, ', repeat('x', 60)) AS text", "id / 4 AS n"
    )
    tables.write_csv(rows.coalesce(1), str(tmp_path / "t"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        back = tables.read_csv(spark, str(tmp_path / "t"), SCHEMA)
        assert back.rdd.getNumPartitions() >= 5
        assert back.exceptAll(rows).isEmpty() and back.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


BAD = 'id,text,n\n1,fine,0.5\nx,no number,1\n2,too few\n3,too,many,4\n4,"quoted, with comma",2\n5,"a, b",no\n'


@pytest.mark.parametrize("columns", [("id", "text", "n"), ("text",)])
def test_rows_that_do_not_fit_are_kept_apart_or_raise(spark, tmp_path, columns):
    (tmp_path / "bad.csv").write_text(BAD)
    good, rejected = tables.read_csv_with_rejects(spark, str(tmp_path / "bad.csv"), SCHEMA)
    want = [(1, "fine", 0.5), (4, "quoted, with comma", 2.0)]
    # The same rows whatever columns are asked for.
    assert sorted(good.select(*columns).collect()) == [
        tuple(dict(zip(("id", "text", "n"), r))[c] for c in columns) for r in want
    ]
    lines = {r["line"]: r["reason"] for r in rejected.collect()}
    assert lines == {
        "x,no number,1": "value", "2,too few": "fields", "3,too,many,4": "fields", '5,"a, b",no': "value",
    }
    assert all(r["file"].endswith("bad.csv") for r in rejected.collect())
    assert good.count() + rejected.count() == BAD.count("\n") - 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), SCHEMA).select(*columns).collect()


def test_foreign_files_with_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,text,n\n1,"two\nlines",1\n2,"a\\nb",2\n')
    found = tables.read_csv(spark, str(tmp_path / "f.csv"), SCHEMA, line_breaks="quoted").collect()
    assert sorted(map(tuple, found)) == [(1, "two\nlines", 1.0), (2, "a\\nb", 2.0)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "f.csv"), SCHEMA, line_breaks="none")
