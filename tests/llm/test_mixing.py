import random
import sys
from collections import defaultdict
from pathlib import Path

from talentgrid.llm import mixing

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402


def raked(cells, targets, sweeps):
    """Cells {(a, b, c): tokens} fitted in plain loops."""
    total = sum(cells.values())
    weight = {k: float(v) for k, v in cells.items()}
    for _ in range(sweeps):
        for i, margin in enumerate(mixing.MARGINS):
            sums = defaultdict(float)
            for k, w in weight.items():
                sums[k[i]] += w
            weight = {k: w * targets[margin].get(k[i], 0) * total / sums[k[i]] if sums[k[i]] else 0.0 for k, w in weight.items()}
    return weight


def test_weights_meet_the_targets(spark):
    draw = random.Random(3)
    cells = {(s, l, t): draw.randint(1, 1000) for s in "abcde" for l in "xyz" for t in "123" if draw.random() < 0.8}
    targets = {"source": {"a": 0.5, "b": 0.2, "c": 0.1, "d": 0.1, "e": 0.1},
               "lang": {"x": 0.2, "y": 0.2, "z": 0.6}, "topic": {"1": 0.3, "2": 0.3, "3": 0.4}}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    shares = {m: spark.createDataFrame(list(t.items()), f"{m} string, share double") for m, t in targets.items()}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(table, shares, 12).collect()}
    want = raked(cells, targets, 12)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)
    total = sum(got.values())
    for i, m in enumerate(mixing.MARGINS):
        for value, share in targets[m].items():
            assert abs(sum(w for k, w in got.items() if k[i] == value) / total - share) < 1e-3


def test_kept_tokens_follow_the_targets(spark):
    draw = random.Random(5)
    rows = []
    for i in range(6000):
        source = "big" if draw.random() < 0.7 else draw.choice("abc")
        rows.append((i, "word " * draw.randint(1, 20), draw.choice(["en", "en", "fr"]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    before, after = defaultdict(int), defaultdict(int)
    for r in found:
        before[r.source] += r.n_tokens
        after[r.source] += r.n_tokens * r.kept
    wanted = {k: v**0.5 for k, v in before.items()}
    for k in before:
        assert abs(after[k] / sum(after.values()) - wanted[k] / sum(wanted.values())) < 0.04


def test_messy_rows(messy, messy_wide, nothing):
    want = sorted(map(tuple, mixing.mix(messy).collect()), key=str)
    assert len(want) == 15 and all(0 <= r[4] <= 1 for r in want)
    assert sorted(map(tuple, mixing.mix(messy_wide).collect()), key=str) == want
    kept = {(r[0], r[5]) for r in want}
    stage = mixing.sample_mix(messy_wide)
    assert stage.columns == messy_wide.columns
    ids = sorted((r.doc_id for r in stage.collect()), key=str)
    assert ids == sorted((r.doc_id for r in messy.collect() if (r.doc_id, True) in kept), key=str)
    assert mixing.mix(nothing).collect() == [] and mixing.sample_mix(nothing).collect() == []


def test_one_rare_document_does_not_set_the_sample(spark):
    draw = random.Random(7)
    rows = [(i, "word%d " % draw.randint(0, 50) * draw.randint(1, 40), draw.choice(["en", "fr"]), draw.choice("aab"))
            for i in range(3000)]
    schema = "doc_id long, text string, lang string, source string"

    def kept(more):
        found = mixing.mix(spark.createDataFrame(rows + more, schema), sweeps=2, share=0.5).collect()
        assert len(found) == len(rows) + len(more) and all(0 <= r.probability <= 1 for r in found)
        return sum(r.n_tokens * r.kept for r in found) / sum(r.n_tokens for r in found)

    rare = [[(9001, None, "en", "new")], [(9001, "rare " * 200, None, "a")]]
    assert all(abs(kept(more) - 0.5) < 0.03 for more in rare)
    docs = spark.createDataFrame(rows + rare[0], schema)
    margins = mixing.achieved_margins(docs, sweeps=2, share=0.5).collect()
    for m in mixing.MARGINS:
        some = [r for r in margins if r.margin == m]
        assert abs(sum(r.kept_tokens for r in some) - 0.5 * sum(r.tokens for r in some)) < 1e-6 * sum(r.tokens for r in some)
        assert abs(sum(r.kept_share for r in some) - 1) < 1e-9
    by = {r.value: r for r in margins if r.margin == "source"}
    assert abs(by["=a"].kept_share - by["=a"].wanted_share) < 0.03
    assert mixing.mix(docs, sweeps=2, share=1.0).where("probability < 1").count() == 0


def test_the_pipeline_keeps_its_share_beside_a_rare_source(spark):
    rows = [(i, f"word{i % 50} " * 20, "en", "ab"[i % 2]) for i in range(2000)] + [(9001, None, "en", "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    n = dict(corpus_pipeline.STAGES)["source mixing"](spark, docs, "").count()
    assert abs(n / len(rows) - corpus_pipeline.KEPT_SHARE) < 0.05
