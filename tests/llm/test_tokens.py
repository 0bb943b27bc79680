import random
import zlib

import numpy as np
import pytest

from talentgrid.llm import packing, token_counts, tokens
from talentgrid.session import shared_folder

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
PARTS = ["a", "Ab", "é", "ß", "Σ", " ", "  ", "\n", "\t", "\r\n", "'s", "12", "###", "<|endoftext|>",
         "<|startoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", " ", "é", "́", "中文", "😀", ".", "　", "İ"]


def whole(name, texts):
    encoded = tokens.load_tokenizer(tokens.tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in encoded]


def test_pieces_give_what_whole_texts_give():
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    counts = tokens.count_tokens(texts, tokens.tokenizer_file(WORDS))
    assert counts == [len(x) for x in whole(WORDS, texts)]
    ids = tokens.token_ids(texts, tokens.tokenizer_file(BYTES))
    assert [x.tolist() for x in ids] == whole(BYTES, texts)


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    cache = tokens.PieceCache(tokens.tokenizer_file(WORDS), tokens.words_apart, len)
    for texts in (["a b c d e f"], ["g h i"], ["a b z", " a  b\n"]):
        assert [x.tolist() for x in tokens.ByteIds(tokens.tokenizer_file(BYTES)).ids(texts)] == whole(BYTES, texts)
    for text in ["a b c d e f", "g h i", "a b z"]:
        (pieces,) = cache.pieces([text])
        assert sum(map(cache.known.__getitem__, pieces)) == len(whole(WORDS, [text])[0])


def counted(docs, folder):
    found = token_counts.count_tokens(docs, folder, tokens.tokenizer_file(WORDS))
    return sorted(map(tuple, found.collect()), key=str)


def test_counts_of_messy_rows(spark, messy, messy_wide, nothing):
    rows = messy.collect()
    texts = [r.text or "" for r in rows]
    want = sorted(
        ((r.doc_id, len(t.encode()), len(i), len(i) > 2048) for r, t, i in zip(rows, texts, whole(WORDS, texts))), key=str
    )
    folder = shared_folder(spark, "cache")
    assert counted(nothing, folder) == []
    assert counted(messy, folder) == want
    stored = token_counts.read_cache(spark, folder).count()
    # Now all are hits: nothing is appended, and a clashing table changes nothing.
    assert counted(messy_wide, folder) == want
    assert token_counts.read_cache(spark, folder).count() == stored == len({t.replace("\n", " ") for t in texts})


def test_stored_counts_are_used_and_kept_by_version(spark):
    folder = shared_folder(spark, "cache")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    counted(docs, folder)
    wrong = token_counts.read_cache(spark, folder).selectExpr("content", "'other' AS version", "n_tokens + 7 AS n_tokens")
    wrong.write.mode("append").parquet(folder)
    before = counted(docs, folder)
    assert [r[2] for r in before] == [len(x) for x in whole(WORDS, ["alpha beta", "gamma"])]


def test_copies_in_the_cache_make_no_rows(spark, messy):
    """As two runs at once, or one started again, would leave it."""
    folder = shared_folder(spark, "cache")
    want = counted(messy, folder)
    spark.read.schema(token_counts.CACHE_SCHEMA).parquet(folder).write.mode("append").parquet(folder)
    assert counted(messy, folder) == want and len(want) == messy.count()


@pytest.mark.parametrize("held", [0, 3, 1000])
def test_few_or_many_misses_are_counted_alike(spark, messy, monkeypatch, held):
    want = counted(messy, shared_folder(spark, "cache"))
    monkeypatch.setattr(token_counts, "HELD", held)
    folder = shared_folder(spark, "cache")
    assert counted(messy.where("doc_id < 5"), folder) == [r for r in want if r[0] is not None and r[0] < 5]
    assert counted(messy, folder) == want


def test_texts_of_hits_are_not_shuffled(spark, messy, monkeypatch):
    folder = shared_folder(spark, "cache")
    want = counted(messy, folder)
    was = token_counts._encoder

    def spied(path):
        inner = was(path)

        def encode(batches):
            for batch in batches:
                assert not batch.num_rows, "a hit was encoded"
                yield from inner([batch])

        return encode

    monkeypatch.setattr(token_counts, "_encoder", spied)
    assert counted(messy, folder) == want


@pytest.mark.parametrize("wide", [False, True])
def test_packing_round_trip(messy, messy_wide, wide):
    docs = (messy_wide if wide else messy).dropDuplicates(["doc_id"])
    path = tokens.tokenizer_file(BYTES)
    pieces = packing.pack(docs, path).collect()
    rows = docs.collect()
    ids = {r.doc_id: np.array([*i, 1], "<u4") for r, i in zip(rows, whole(BYTES, [r.text or "" for r in rows]))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc_id, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc_id])
            assert p.ids_crc32 == zlib.crc32(ids[doc_id][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[doc_id])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or number == len(by_sequence) - 1


def test_packing_nothing_and_repeats(spark, nothing):
    path = tokens.tokenizer_file(BYTES)
    assert packing.pack(nothing, path).collect() == []
    docs = spark.createDataFrame([(1, "same words")] * 5 + [(None, None)], "doc_id long, text string")
    pieces = packing.pack(docs, path).collect()
    assert sorted(p.offset for p in pieces) == list(
        np.cumsum([0] + [p.length for p in sorted(pieces, key=lambda p: p.offset)])[:-1]
    )
    assert len(pieces) == 6


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert set(steps.tolist()) == {1}


def test_ids_of_every_settled_character_and_of_others():
    ids = tokens.ByteIds(tokens.tokenizer_file(BYTES))
    assert ids.fast is not None
    texts = []
    for code in [*range(0x600), *range(0x2000, 0x2800), *range(0x3000, 0x3100), *range(0x4E00, 0x9FB0, 97), *range(0xAC00, 0xD7B0, 89),
                 *range(0xFF00, 0xFFF0), *range(0x1F300, 0x1FA00, 3), *range(0x10400, 0x10450), 0xA7CE, 0x2EBF0, 0x1E4D0]:
        c = chr(code)
        texts.append(f"a{c}b 1{c} {c}{c}x  {c}'s \n{c} {c}2{c}")
    assert [x.tolist() for x in ids.ids(texts)] == whole(BYTES, texts)
    assert sum(tokens._UNSETTLED.search(t) is not None for t in texts) > 100
    ids.fast = None
    assert [x.tolist() for x in ids.ids(texts[:300])] == whole(BYTES, texts[:300])


@pytest.mark.parametrize("text", ["a" * 300_000, "ab1" * 100_000, " " * 300_000, "\n" * 200_000 + "x", "é$" * 100_000, "'s" * 100_000])
def test_ids_of_long_runs(text):
    assert tokens.token_ids([text], tokens.tokenizer_file(BYTES))[0].tolist() == whole(BYTES, [text])[0]


def test_other_vocabularies_take_the_library():
    import json
    from pathlib import Path

    file = json.loads(Path(tokens.tokenizer_file(BYTES)).read_text())
    assert tokens.ByteIds._encoding(file) is not None
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None},
                   {"pre_tokenizer": {**file["pre_tokenizer"], "add_prefix_space": True}},
                   {"model": {**file["model"], "merges": file["model"]["merges"][::-1]}}):
        assert tokens.ByteIds._encoding({**file, **change}) is None
