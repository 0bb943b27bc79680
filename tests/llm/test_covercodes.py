"""Codebooks by cover trees against plain Lloyd rounds."""

import hashlib

import numpy as np
import pytest

from talentgrid.llm import covercodes
from talentgrid.llm.covercodes import assign, compress, cover_tree


def check_tree(tree, parts):
    n = len(tree["points"])
    assert (tree["points"][tree["inverse"]] == parts).all()
    assert tree["low"][0] == 0 and tree["high"][0] == n and tree["counts"][0] == len(parts)
    for k in range(len(tree["low"])):
        low, high = tree["low"][k], tree["high"][k]
        below, weights = tree["points"][low:high], tree["weights"][low:high]
        assert (tree["sums"][k] == (below * weights[:, None]).sum(axis=0)).all()
        assert tree["counts"][k] == weights.sum()
        away = np.sqrt(((below - tree["centre"][k]) ** 2).sum(axis=1))
        assert away.min() == 0 and np.isclose(away.max(), tree["reach"][k])
        first, last = tree["first"][k], tree["last"][k]
        if last > first:  # children share out the points of their parent
            ranges = sorted(zip(tree["low"][first:last], tree["high"][first:last]))
            assert ranges[0][0] == low and ranges[-1][1] == high
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        else:
            assert high - low <= covercodes.LEAF or high - low == 1


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal", "one"])
def test_trees_hold_their_points_and_assign_as_brute_force(kind):
    draw = np.random.default_rng(5)
    parts = {
        "spread": draw.integers(-500, 500, (700, 4)),
        "clustered": draw.integers(-9, 9, (900, 4)) + 1000 * draw.integers(0, 4, (900, 1)),
        "equal": np.tile([[3, -4, 5, 6]], (50, 1)),
        "one": np.array([[1, 2, 3, 4]]),
    }[kind].astype(float)
    tree = cover_tree(parts)
    check_tree(tree, parts)
    entries = np.concatenate([parts[: 5], parts[: 2], parts[-3:] + 1])
    gaps = ((tree["points"][:, None] - entries) ** 2).sum(axis=2)
    got, whole = np.full(len(tree["points"]), -1), 0
    for nodes, points, chosen in assign(tree, entries):
        if nodes is None:
            got[points] = chosen
            continue
        whole += len(nodes)
        for k, c in zip(nodes, chosen):
            assert (got[tree["low"][k]: tree["high"][k]] == -1).all()
            got[tree["low"][k]: tree["high"][k]] = c
    assert (got == gaps.argmin(axis=1)).all()
    assert kind != "clustered" or whole


def test_siblings_lie_apart():
    parts = np.random.default_rng(6).integers(-500, 500, (600, 3)).astype(float)
    tree = cover_tree(parts)
    level = tree["reach"][0] and np.sqrt(((np.unique(parts, axis=0) - np.unique(parts, axis=0)[0]) ** 2).sum(axis=1).max())
    kids = tree["centre"][tree["first"][0]: tree["last"][0]]
    gaps = np.sqrt(((kids[:, None] - kids) ** 2).sum(axis=2))[~np.eye(len(kids), dtype=bool)]
    assert len(kids) > 1 and gaps.min() > level / 2


def plain(rows, parts=8, entries=16, rounds=6):
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(np.float32(r[1]))))
    x = np.array([np.floor(4096 * np.float32(r[1]).astype(float)) for r in kept]).astype(int)
    cut = x.reshape(len(x), parts, -1)
    books = [cut[: min(entries, sum(r[0] is not None for r in kept)), p].copy() for p in range(parts)]

    def nearest(p):
        gaps = ((cut[:, p, None] - books[p]) ** 2).sum(axis=2)
        return gaps.argmin(axis=1), gaps.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            own = nearest(p)[0]
            for e in set(own.tolist()):
                books[p][e] = cut[own == e, p].sum(axis=0) // (own == e).sum()
    found = [nearest(p) for p in range(parts)]
    errors = sum(d for _, d in found).tolist()
    totals = {}
    for r, error in zip(kept, errors):
        totals[r[2]] = totals.get(r[2], 0) + error
    said = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    codes = ["".join(f"{c[k]:02x}" for c, _ in found) for k in range(len(kept))]
    return sorted(((r[0], c, e, totals[r[2]], said) for r, c, e in zip(kept, codes, errors)), key=str)


def test_messy_rows_as_in_a_loop(vectors, vectors_wide, sound_rows, monkeypatch):
    monkeypatch.setattr(covercodes, "BLOCK", 64)
    want = plain(sound_rows)
    for df in (vectors, vectors_wide):
        assert sorted(map(tuple, compress(df).collect()), key=str) == want


def test_null_ids_and_labels_repeated_rows_and_few_rows(spark, no_vectors, sound_rows):
    rows = [(i, v, None if i % 2 else 3) for i, v, _ in sound_rows[:7]]
    rows += [rows[3], rows[3], (None, sound_rows[9][1], 3), (None, sound_rows[10][1], None)]
    df = spark.createDataFrame(rows, no_vectors.schema)
    assert sorted(map(tuple, compress(df).collect()), key=str) == plain(rows)
    assert compress(no_vectors).collect() == []


def test_what_cannot_be_coded_raises(spark, no_vectors):
    def rows(*vectors):
        return spark.createDataFrame([(i, list(v), 1) for i, v in enumerate(vectors)], no_vectors.schema)

    with pytest.raises(ValueError):
        compress(rows([0.0] * 16, [0.0] * 8))
    with pytest.raises(ValueError):
        compress(rows([0.0] * 12))
    with pytest.raises(ValueError):
        compress(rows([0.0] * 16), entries=300)
    with pytest.raises(ArithmeticError):
        compress(rows([1e9] * 16))
