import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from talentgrid.llm import neardup  # noqa: E402
from talentgrid.session import shared_folder  # noqa: E402


def test_stages_on_messy_rows(spark, messy_wide, nothing):
    """Four stages give the columns they get, the last gives pieces; none fails."""
    for start in (messy_wide, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == start.columns and docs.count() <= start.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_near_duplicates_leave_one_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, "").collect()}
    rows = [(r.doc_id, neardup.shingle_set(r.text or "", 5)) for r in docs.collect()]
    group = {d: d for d, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            shared = len(x & y)
            if x and y and 100 * shared >= 80 * (len(x) + len(y) - shared):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    assert kept == {d for d, _ in rows if root(d) == d}


def test_run_packs_what_the_stages_keep(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()} != set()
    total = sum(r.length for r in pieces)
    assert max(r.sequence_id for r in pieces) == (total - 1) // 2048


def test_a_run_leaves_one_folder(spark):
    work = Path(shared_folder(spark, "x").removeprefix("file:")).parent
    before = set(work.glob("*"))
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name.rpartition("-")[0] for p in set(work.glob("*")) - before] == ["sequence-packing"]
    assert pieces.count() > 0
