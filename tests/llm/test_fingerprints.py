import hashlib

import numpy as np

from talentgrid.llm import fingerprints as fp


def plain(rows):
    """The same result in one loop: descending ids, null ids last, ties by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    marks = [fp.simhash(t) for t in texts]
    out = []
    for i, (row, text) in enumerate(zip(order, texts)):
        j = (i + 1) % len(order)
        half = len(text) // 2
        edited = text[: len(text) - half] + texts[j][:half]
        near = sum(int(np.bitwise_count(marks[i] ^ m).sum()) <= fp.RADIUS for m in marks) - 1
        out.append(
            (row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(),
             marks[i].astype(">u8").tobytes().hex(), round(fp.likeness(marks[i], fp.simhash(edited)), 9),
             round(fp.likeness(marks[i], marks[j]), 9), near)
        )
    return sorted(out, key=str)


def got(docs):
    found = fp.with_near_counts(fp.fingerprint_documents(docs)).collect()
    return sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9),
          round(r.near_next, 9), r.n_near) for r in found),
        key=str,
    )


def test_messy_rows_as_in_a_loop(messy, messy_wide):
    want = plain([(r.doc_id, r.text) for r in messy.collect()])
    assert got(messy) == want
    assert got(messy_wide) == want


def test_nothing_and_one(spark, nothing):
    assert got(nothing) == []
    one = spark.createDataFrame([(5, "a few words only")], "doc_id long, text string")
    assert got(one) == plain([(5, "a few words only")])


def test_all_near_pairs_are_found(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, (3, 4), np.uint64)
    marks = []
    for i in range(400):
        bits = np.unpackbits(base[i % 3].astype(">u8").view(np.uint8))
        flip = draw.choice(256, draw.integers(0, 9), replace=False)
        bits[flip] ^= 1
        marks.append(np.packbits(bits).tobytes())
    whole = np.stack([np.frombuffer(m, ">u8").astype(np.uint64) for m in marks])
    for radius in (3, 7):
        near = (np.bitwise_count(whole[:, None] ^ whole[None]).sum(axis=2) <= radius).sum(axis=1) - 1
        table = spark.createDataFrame([(m.hex(),) for m in marks], "fingerprint string")
        found = {r.fingerprint: r.n_near for r in fp.near_counts(table, radius).collect()}
        assert [found[m.hex()] for m in marks] == near.tolist()


def test_likeness_follows_the_edit():
    text = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"term{i}" for i in range(400))
    half = len(text) // 2
    edited = text[: len(text) - half] + other[:half]
    a, b, c = map(fp.simhash, (text, edited, other))
    assert fp.likeness(a, c) + 0.08 < fp.likeness(a, b) < 1
    assert fp.likeness(a, fp.simhash(text)) == 1


def test_replaced_words_stay_near(spark):
    """One to three replaced words at 100 to 400 words: pairs are found, and as in a loop."""
    draw = np.random.default_rng(11)
    texts = []
    for n in (100, 200, 400):
        for changes in (1, 2, 3) * 5:
            words = [f"w{x}" for x in draw.integers(0, 5000, n)]
            other = list(words)
            for at in draw.choice(n, changes, replace=False):
                other[at] = f"new{draw.integers(10**6)}"
            texts += [" ".join(words), " ".join(other)]
    marks = np.stack([fp.simhash(t) for t in texts])
    apart = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2)
    table = spark.createDataFrame([(m.astype(">u8").tobytes().hex(),) for m in marks], "fingerprint string")
    found = {r.fingerprint: r.n_near for r in fp.near_counts(table).collect()}
    got = [found[m.astype(">u8").tobytes().hex()] for m in marks]
    assert got == ((apart <= fp.RADIUS).sum(axis=1) - 1).tolist()
    assert sum(n > 0 for n in got) >= 0.95 * len(got)


def test_lists_of_a_shared_byte_all_meet(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 16)
    draw = np.random.default_rng(12)
    base = np.unpackbits(draw.integers(0, 256, 32, np.uint8))
    marks = []
    for _ in range(150):
        bits = base.copy()
        bits[draw.choice(256, draw.integers(0, 33), replace=False)] ^= 1
        marks += [np.packbits(bits)] * int(draw.integers(1, 3))
    whole = np.stack(marks)
    near = (np.bitwise_count(whole[:, None] ^ whole[None]).sum(axis=2) <= fp.RADIUS).sum(axis=1) - 1
    table = spark.createDataFrame([(m.tobytes().hex(),) for m in marks], "fingerprint string")
    found = {r.fingerprint: r.n_near for r in fp.near_counts(table).collect()}
    assert [found[m.tobytes().hex()] for m in marks] == near.tolist()
