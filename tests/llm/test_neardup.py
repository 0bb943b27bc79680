import random

import numpy as np
import pytest

from talentgrid.llm import neardup
from talentgrid.llm.components import components


def plain(rows, width, percent):
    """Every pair of rows compared; ids joined where any two of their texts are alike."""
    nodes = sorted({r[0] for r in rows if r[0] is not None})
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r[0], neardup.shingle_set(r[1] or "", width)) for r in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(
        ((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=str
    )


def got(docs, width, percent):
    return sorted(map(tuple, neardup.near_duplicates(docs, width, percent).collect()), key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_messy_rows(messy, messy_wide, width, percent):
    want = plain([(r.doc_id, r.text) for r in messy.collect()], width, percent)
    assert got(messy, width, percent) == want
    assert got(messy_wide, width, percent) == want


def test_nothing(nothing):
    assert got(nothing, 5, 80) == []
    assert neardup.keep_one_each(nothing).collect() == []


def family(draw, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(*changes)):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_copies_chains_and_unlike_relatives(spark):
    """Copies, near copies, chains through a middle text, and many texts that share
    bands without being linked: components are those of all pairs."""
    draw = random.Random(8)
    texts = []
    for f in range(4):
        base = [f"w{f}x{draw.randrange(400)}" for _ in range(150)]
        texts += family(draw, base, 60, (0, 6))
        texts += family(draw, base, 40, (4, 14))
        texts += [" ".join(base)] * 30
    chain = [f"c{i}" for i in range(120)]
    for step in range(25):
        chain = chain[3:] + [f"c{step}n{i}" for i in range(3)]
        texts.append(" ".join(chain))
    draw.shuffle(texts)
    rows = list(enumerate(texts, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 3, 85) == plain(rows, 3, 85)


def test_crossing_links_reach_what_stars_miss(spark, monkeypatch):
    """In a band led by an unlike text the others still find each other, block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    text = " ".join(f"w{i}" for i in range(100))
    low, far = dict(n=98, low=0, high=0), dict(n=98, low=-1, high=-1)
    members = spark.createDataFrame(
        [(1, dict(id=0, **far), 0, 12)] + [(1, dict(id=i, **low), 0, 12) for i in range(1, 12)],
        "key long, x struct<id:long,n:long,low:long,high:long>, first long, rows long",
    )
    bands = spark.createDataFrame([(i, [5 * i + 100, 1]) for i in range(12)], "id long, bands array<long>")
    texts = spark.createDataFrame([(i, text if i else "other") for i in range(12)], "doc_id long, text string")

    def links(labels):
        grouped = spark.createDataFrame(labels, "node long, label long")
        return neardup._crossing_links(members, grouped, bands, texts, 3, 85)

    found = {r.node: r.label for r in components(links([])).collect()}
    assert found == {i: 1 for i in range(1, 12)}
    halves = [(i, 1 + i % 2) for i in range(1, 12)]
    assert 1 <= links(halves).count() <= 12
    assert links([(i, 1) for i in range(1, 12)]).collect() == []


def test_words_and_shingles():
    assert neardup.words_of(" A\x0bbÉ\tC\u00a0d\n") == [b"a", "bÉ".encode(), "c\u00a0d".encode()]
    assert neardup.shingle_set("A b", 3) == {(b"a", b"b")}
    assert len(neardup.shingle_hashes([b"a", b"b"], 3)) == 1
    words = [str(i % 7).encode() for i in range(50)]
    assert len(neardup.shingle_hashes(words, 3)) == len(set(zip(words, words[1:], words[2:])))


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(0)
    signer = neardup.MinMaxSigner()
    errors = []
    for share in (0.3, 0.6, 0.85):
        for _ in range(30):
            both = draw.integers(0, 2**63, int(1000 * share), np.uint64)
            rest = draw.integers(0, 2**63, (2, (1000 - len(both)) // 2), np.uint64)
            a, b = (signer.signature(np.concatenate([both, r])) for r in rest)
            errors.append((a == b).mean() - share)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(20)] + [(7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(21)}}


def test_one_of_each_group_stays_with_its_columns(messy_wide):
    kept = neardup.keep_one_each(messy_wide)
    assert kept.columns == messy_wide.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and {4, 5, 6, 7} <= set(ids) and None in ids


@pytest.mark.parametrize("percent", [0, 50, 79, 101])
def test_similarities_that_bands_do_not_serve_are_refused(messy, percent):
    with pytest.raises(ValueError):
        neardup.near_duplicates(messy, 5, percent)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_long_texts_in_small_blocks(spark, monkeypatch, percent):
    """Many near copies of one text and of another: blocks are cut by rows and by shingles."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(2):
        base = draw.choices(words, k=120)
        for i in range(30):
            own = list(base)
            for _ in range(draw.randint(0, 5)):
                own[draw.randrange(120)] = draw.choice(words)
            rows.append((len(rows), " ".join(own)))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs, 3, percent) == plain(rows, 3, percent)
