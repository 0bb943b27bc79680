"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from talentgrid.llm import neighbours
from talentgrid.llm.neighbours import axis_codes, best_rows, hadamard, nearest, probe_order, table_signs, turned


@pytest.mark.parametrize("dims", [1, 2, 8, 64])
def test_hadamard_is_the_matrix(dims):
    full = np.array([[1.0]])
    while len(full) < dims:
        full = np.block([[full, full], [full, -full]])
    x = np.random.default_rng(1).normal(size=(5, dims))
    assert np.allclose(hadamard(x), x @ full.T / np.sqrt(dims))


def test_rotations_keep_lengths_and_the_first_probe_is_the_own_code():
    x = np.random.default_rng(2).normal(size=(50, 24))
    signs = table_signs(6, 24)
    assert signs.shape == (6, 3, 32)
    assert np.allclose((turned(x, signs[0]) ** 2).sum(axis=1), (x**2).sum(axis=1))
    order = probe_order(x, signs)
    assert (order[:, :, 0] == axis_codes(x, signs)).all()
    assert (np.sort(order, axis=2) == np.arange(64)).all()
    # Opposite vectors have opposite axes, at the end of each other's order.
    assert (axis_codes(-x, signs) == order[:, :, -1]).all()


def test_best_rows_break_ties_by_id():
    rows = np.tile([0.6, 0.8], (1000, 1))
    ids = np.random.default_rng(3).permutation(1000)
    _, j, score = best_rows(np.array([[0.6, 0.8]]), np.array([4]), rows, ids, 6)
    assert ids[j].tolist() == [0, 1, 2, 3, 5, 6] and len(set(score.tolist())) == 1


def plain(rows, asked, most):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    found = {}
    for q in np.flatnonzero([asked(int(i)) for i in ids]):
        score = neighbours.exact_products(x, np.tile(x[q], (len(x), 1)))
        order = [k for k in np.lexsort((ids, -score)) if k != q][:most]
        found[int(ids[q])] = [(int(ids[k]), float(score[k])) for k in order]
    return found


def listed(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(got, want):
    shares = [len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()]
    return sum(shares) / len(shares)


def test_messy_rows(vectors, vectors_wide, sound_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    want = plain(sound_rows, lambda i: i % 4 == 0, 20)
    scores = {q: dict(plain(sound_rows, lambda i: i == q, 1000)[q]) for q in (0, 40)}
    for df in (vectors, vectors_wide):
        got = listed(nearest(df, "vec_id % 4 = 0"))
        assert got.keys() == want.keys() and recall(got, want) >= 0.9
        for q, own in scores.items():
            assert len(got[q]) == 20 and all(own[i] == s for i, s in got[q])
            assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
        # Of a third of all rows that are equal, the smallest ids come back, exactly.
        assert got[40] == want[40]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_rows(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = listed(nearest(df, "vec_id % 20 = 0"))
    assert recall(got, plain(rows, lambda i: i % 20 == 0, 20)) >= 0.9
    assert all(len(found) == 20 for found in got.values())


def test_small_tables_are_whole(vectors, sound_rows, no_vectors, spark):
    few = vectors.where("vec_id < -5")
    assert listed(nearest(few, "vec_id % 2 = 0")) == plain(sound_rows[:15], lambda i: i % 2 == 0, 20)
    assert nearest(no_vectors, "vec_id % 2 = 0").collect() == []
    assert nearest(vectors, "vec_id = 5000").collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (2, [0.0, 0.0], 1), (None, [1.0, 1.0], 1)], no_vectors.schema)
    assert nearest(alone, "vec_id % 2 = 0").collect() == []


def test_a_query_that_meets_too_few_looks_everywhere(vectors, sound_rows, monkeypatch):
    """With one probe and one table, buckets hold fewer rows than asked for."""
    monkeypatch.setattr(neighbours, "fitted_probes", lambda *_: 1)
    want = plain(sound_rows, lambda i: i % 40 == 0, 300)
    assert listed(nearest(vectors, "vec_id % 40 = 0", 300, tables=1)) == want


def test_repeated_ids_and_unequal_lengths(spark, no_vectors):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 2), (5, [0.5, 0.5], 1), (5, [0.5, 0.5], 1), (6, [0.4, 0.0], 1)]
    got = listed(nearest(spark.createDataFrame(rows, no_vectors.schema), "vec_id = 0"))
    assert [i for i, _ in got[0]] == [5, 6]
    with pytest.raises(ValueError):
        nearest(spark.createDataFrame(rows + [(7, [1.0], 1)], no_vectors.schema), "vec_id = 0")
