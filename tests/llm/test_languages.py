import random

import numpy as np
import pytest

from talentgrid.llm import languages as lid


@pytest.fixture(scope="module")
def spoken(spark):
    """Three made-up languages by their syllables; a third of all rows are one text."""
    draw = random.Random(3)
    sounds = {"aa": "ka lo mi ta re".split(), "bb": "sch ung ver eit ich".split(), "cc": "oux ent ais eur ons".split()}

    def text(lang):
        return " ".join("".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 4))) for _ in range(40))

    rows = [(i, text(lang), lang) for i, lang in enumerate(draw.choices(list(sounds), k=300))]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(150)]
    rows += [(2000, None, "aa"), (2001, "12 !? ##", "aa"), (2002, text("cc"), None), (None, text("bb"), "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_languages_are_found(spoken):
    found = {r.doc_id: r for r in lid.identify(spoken).collect()}
    said = {r.doc_id: r.lang for r in spoken.collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id < 2000]
    assert len(held) > 40 and all(r.lang_pred == said[r.doc_id] for r in held)
    assert found[2000].lang_pred == found[2001].lang_pred == "und" and found[2000].score == 0
    assert found[2002].lang_pred == "cc" and found[None].lang_pred == "bb"
    assert not found[None].held_out
    assert all(0 <= r.score <= 1 for r in found.values())


def test_lang_is_no_input(spark, spoken):
    model = lid.fit(lid.training_rows(spoken, ~lid.held_out()))
    with_lang = {r.doc_id: (r.lang_pred, r.score) for r in lid.predict(spoken, model).collect()}
    without = spoken.selectExpr("doc_id", "text", "'aa' AS lang")
    assert with_lang == {r.doc_id: (r.lang_pred, r.score) for r in lid.predict(without, model).collect()}


def test_nothing_to_learn_from(nothing, messy, messy_wide):
    assert lid.identify(nothing).collect() == []
    assert {r.lang_pred for r in lid.predict(messy, None).collect()} == {"und"}
    assert lid.identify(messy).count() == lid.identify(messy_wide).count() == 15


def test_scores_are_the_kernel_machine(spoken):
    """The one weight matrix gives what kernel, root and regression give step by step."""
    rows = lid.training_rows(spoken, ~lid.held_out(), 60)
    model = lid.fit(rows, 20)
    sets = [set(s.tolist()) for _, s in rows]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets[:20]] for a in sets])
    values, vectors = np.linalg.eigh(kernel[:20])
    strong = values > 1e-6 * values.max()
    features = kernel @ (vectors[:, strong] / np.sqrt(values[strong]))
    targets = np.array([[lang == x for x in model.languages] for lang, _ in rows], float)
    weight = 1 / (targets.sum(axis=0) @ targets.T)
    solved = np.linalg.solve(
        features.T @ (features * weight[:, None]) + lid.RIDGE * np.eye(strong.sum()) / 20,
        features.T @ (targets * weight[:, None]),
    )
    assert np.allclose(model.scores([s for _, s in rows]), features @ solved, atol=2e-3)


def test_the_sample_is_bounded_and_balanced(spoken):
    rows = lid.training_rows(spoken, ~lid.held_out(), 30)
    assert len(rows) == 30
    counts = {}
    for lang, _ in rows:
        counts[lang] = counts.get(lang, 0) + 1
    assert set(counts.values()) == {10}


@pytest.mark.parametrize("most", [1, 7, 60, 10_000])
def test_training_rows_are_the_first_by_hash(spark, spoken, monkeypatch, most):
    """Whatever the bits by which rows are counted first; compared with a plain choice."""
    rows = spoken.where("lang IS NOT NULL AND text RLIKE '[a-z]'").selectExpr(
        "lang", "xxhash64(CAST(doc_id AS string), text) AS o").distinct().collect()
    by_lang = {}
    for r in sorted(rows, key=lambda r: r.o):
        by_lang.setdefault(r.lang, []).append(r.o)
    turns = sorted((i, lang) for lang, own in by_lang.items() for i in range(len(own)))[:most]
    want = [lang for _, lang in turns]
    for bits in (1, 12):
        monkeypatch.setattr(lid, "ORDER_BITS", bits)
        assert [lang for lang, _ in lid.training_rows(spoken, lid.F.lit(True), most)] == want
