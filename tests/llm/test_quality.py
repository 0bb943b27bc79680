import math
import re
from collections import Counter

import pytest

from talentgrid.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts_of_messy_rows(messy, messy_wide):
    want = sorted(((r.doc_id, *counts(r.text)) for r in messy.collect()), key=str)
    for docs in (messy, messy_wide):
        found = q.judge(docs)
        got = sorted(
            ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
             for r in found.collect()),
            key=str,
        )
        assert got == want


@pytest.mark.parametrize(
    "text", ["a b c a b c", "a b c d", "a a a a", "a b a b a b a", "x y z\nx y z x y", "a b c  a\tb c q a b c"]
)
def test_repeated_windows(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert q.text_counts(docs, []).first().n_repeat_words == counts(text)[4]


def fitted(patterns):
    """The same estimation in plain loops: posterior of each pattern."""
    n = len(q.RULES)
    good, on_good, on_bad = q.GOOD_SHARE, [q.RIGHT_ON_GOOD] * n, [q.RIGHT_ON_BAD] * n

    def posterior(votes):
        odds = math.log(good) - math.log(1 - good)
        for v, g, b in zip(votes, on_good, on_bad):
            odds += {1: math.log(g) - math.log(1 - b), -1: math.log(1 - g) - math.log(b), 0: 0.0}[v]
        return 1 / (1 + math.exp(-odds))

    behind = q.PRIOR * sum(patterns.values())
    for _ in range(q.ROUNDS):
        post = {p: posterior(p) for p in patterns}
        right = {
            s: [
                (sum(k * m(post[p]) for p, k in patterns.items() if p[i] == s) + behind * start + 1)
                / (sum(k * m(post[p]) for p, k in patterns.items() if p[i] != 0) + behind + 2)
                for i in range(n)
            ]
            for s, m, start in ((1, lambda x: x, q.RIGHT_ON_GOOD), (-1, lambda x: 1 - x, q.RIGHT_ON_BAD))
        }
        good = (sum(k * post[p] for p, k in patterns.items()) + 1) / (sum(patterns.values()) + 2)
        on_good, on_bad = right[1], right[-1]
    return {p: posterior(p) for p in patterns}


def test_estimation_as_in_loops(spark):
    n = len(q.RULES)
    patterns = {(1,) * n: 800, (-1, -1) + (0,) * (n - 2): 60, (1, -1, 0) + (1,) * (n - 3): 30,
                (0,) * n: 40, (-1,) * n: 50, (1, 1, -1) + (0,) * (n - 3): 20}
    rows = [(list(p),) for p, k in patterns.items() for _ in range(k)]
    model = q.quality_model(spark.createDataFrame(rows, "votes array<int>"))
    got = {tuple(r.votes): r.posterior for r in model.collect()}
    want = fitted(patterns)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_junk_goes_and_clean_text_stays(spark):
    from random import Random

    draw = Random(4)
    words = [draw.choice("light river stone garden paper".split()) + draw.choice("abcdefghij") + draw.choice("klmnop") for _ in range(5000)]
    clean = [" ".join(draw.choices(words, k=80)).capitalize() + ".\n" + " ".join(draw.choices(words, k=60)) for _ in range(200)]
    junk = [" ".join(w + "%%%" for w in draw.choices(words, k=90)) for _ in range(15)]
    junk += [" ".join(draw.choices(words, k=90)).upper().replace(" ", "!! ") for _ in range(15)]
    junk += ["same old line again\n" * 40 + " ".join(draw.choices(words, k=200)) for _ in range(15)]
    rows = list(enumerate(clean)) + list(enumerate(junk, 1000))
    kept = {r.doc_id for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(len(clean)))


def test_stage_keeps_rows_and_columns(messy_wide, nothing):
    verdict = {r.doc_id: r.kept for r in q.judge(messy_wide).collect()}
    kept = q.keep_good(messy_wide)
    assert kept.columns == messy_wide.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted(
        (r.doc_id for r in messy_wide.collect() if verdict[r.doc_id]), key=str
    )
    assert rows[0].kept == "kept"  # the table's own column, untouched
    assert q.judge(nothing).collect() == [] and q.keep_good(nothing).collect() == []
