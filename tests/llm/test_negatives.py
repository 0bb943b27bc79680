"""Hard negatives against plain scores."""

import numpy as np
import pytest

from talentgrid.llm import negatives
from talentgrid.llm.negatives import deepened, hard_negatives, pack_planes, subset_sums, table_scores, unpack_planes


@pytest.mark.parametrize("dims", [1, 7, 8, 13, 64])
def test_table_scores_are_inner_products(dims):
    draw = np.random.default_rng(dims)
    a, b = draw.integers(-300, 300, (9, dims)), draw.integers(-70, 900, (600, dims))
    planes, depth = pack_planes(b)
    assert (unpack_planes(planes, dims) == b).all()
    assert (table_scores(subset_sums(a), planes) == a @ b.T).all()
    deeper = deepened(planes, depth + 3)
    assert (unpack_planes(deeper, dims) == b).all()
    assert (table_scores(subset_sums(a), deeper) == a @ b.T).all()


def test_extremes_of_the_planes():
    values = np.array([[0, -1, 1, -256, 256, 255, -255, -2**40, 2**40]])
    planes, depth = pack_planes(values)
    assert depth == 42 and (unpack_planes(planes, 9) == values).all()


def plain(rows, anchor, positives=5, count=3, low=50, high=95):
    kept = sorted((i, label, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v, label in rows)
    out = []
    for a, own, x in kept:
        if not anchor(a):
            continue
        scored = sorted(((int(x @ y), i, label) for i, label, y in kept if i != a), key=lambda t: (-t[0], t[1]))
        for p, positive, _ in [t for t in scored if t[2] == own][:positives]:
            there = [t for t in scored if t[2] != own and low * p <= 100 * t[0] <= high * p][:count]
            out += [(a, positive, k + 1, i, p, s) for k, (s, i, _) in enumerate(there)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    """Many cells, also some that hash leaves without a row."""
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "CANDIDATES", 32)


def test_messy_rows_as_in_a_loop(vectors, vectors_wide, sound_rows, small_blocks):
    want = plain(sound_rows, lambda i: i % 5 == 0)
    for df in (vectors, vectors_wide):
        assert sorted(map(tuple, hard_negatives(df, "vec_id % 5 = 0").collect())) == want and want


def test_other_limits(vectors, sound_rows):
    want = plain(sound_rows, lambda i: i == 30, 2, 1000, 10, 100)
    got = hard_negatives(vectors, "vec_id = 30", positives=2, negatives=1000, low=10, high=100)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_repeated_rows_nulls_and_nothing(spark, no_vectors):
    schema = no_vectors.schema
    assert hard_negatives(no_vectors, "vec_id % 5 = 0").collect() == []
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [9.0, 9.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1),
            (2, [0.9, 0.1], 2), (3, [0.9, 0.1], None), (None, [0.9, 0.1], 2)]
    df = spark.createDataFrame(rows, schema)
    assert hard_negatives(df, "vec_id = 77").collect() == []
    got = list(map(tuple, hard_negatives(df, "vec_id = 0").collect()))
    assert got == [(0, 1, 1, 2, 65536, 58880)]
    # An anchor alone in its label has no positive, so no negative.
    assert hard_negatives(df, "vec_id = 2").collect() == []


def test_unequal_lengths_and_too_large_scores_raise(spark, no_vectors):
    unequal = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1)], no_vectors.schema)
    with pytest.raises(ValueError):
        hard_negatives(unequal, "vec_id = 0")
    large = spark.createDataFrame([(0, [1e12, 2.0], 1), (1, [1.0, 1.0], 1)], no_vectors.schema)
    with pytest.raises(ArithmeticError):
        hard_negatives(large, "vec_id = 0")
