import zlib

import numpy as np
import pytest

from talentgrid.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_a_permutation_of_any_size(size):
    keys = sharding.round_keys(7)
    once = sharding.permute(np.arange(size), size, keys)
    assert sorted(once) == list(range(size))
    assert (once == sharding.permute(np.arange(size), size, keys)).all()
    if size > 100:
        assert not (once == np.arange(size)).all()
        assert not (once == sharding.permute(np.arange(size), size, sharding.round_keys(8))).all()


def plain(rows, shards):
    order = sorted(
        ((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]),
    )
    places = sharding.permute(np.arange(len(order)), len(order), sharding.round_keys(17))
    return sorted(((d, s, c, int(p) % shards, int(p) // shards) for (d, c, s), p in zip(order, places)), key=str)


def test_messy_rows_as_in_a_loop(messy, messy_wide):
    want = plain([(r.doc_id, r.text) for r in messy.collect()], 4)
    for docs in (messy, messy_wide):
        assert sorted(map(tuple, sharding.shard_rows(docs, 4).collect()), key=str) == want


def test_counts_are_even_and_slots_have_no_gap(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "repeat('x', id % 50) AS text")
    by_shard = {}
    for r in sharding.shard_rows(docs, 16).collect():
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = [len(x) for x in by_shard.values()]
    assert len(by_shard) == 16 and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())


def test_nothing(nothing):
    assert sharding.shard_rows(nothing, 16).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(nothing, 0)
