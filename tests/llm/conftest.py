import random

import pytest

#: Extra columns whose names the operators use themselves.
CLASHING = (
    "kept string, n_words string, votes string, posterior string, row string, number string, "
    "position string, key string, bucket string, content string, bands string, label string, "
    "spans string, topic string, weight string, probability string, tokens string"
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed: int, n: int) -> str:
    draw = random.Random(seed)
    stems = ["the", "of", "river", "stone", "light", "market", "garden", "winter", "paper", "signal"]
    return " ".join(draw.choice(stems) + draw.choice(["", "s", "ed", "er"]) for _ in range(n))


def messy_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = sentence(1, 120)
    near = base + " more"
    rows = [
        (1, base, "en", "a", len(base)),
        (2, near, "en", "a", len(near)),
        (3, base, "en", "b", len(base)),
        (3, base, "en", "b", len(base)),
        (4, None, "en", "b", None),
        (5, "", None, "b", 0),
        (6, " \t\n ", "fr", None, 4),
        (7, "one", "fr", "c", 3),
        (8, sentence(2, 30_000), "fr", "c", 0),
        (9, sentence(3, 80) + "\n" + "same line here\n" * 40, "fr", "c", 0),
        (None, sentence(4, 90), None, None, None),
        (None, sentence(4, 90), None, None, None),
        (11, "été ñandú straße 中文 😀 " + sentence(5, 60), "fr", "a", 0),
        (12, "%%% $$$ ### &&& " * 60, "en", "a", 0),
        (13, "mail ann.42@mail8.example.com card 4111111111111111 " + sentence(6, 70), "en", "a", 0),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def messy_wide(spark):
    """The same rows with columns that clash with the operators' own names."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(*r, *names) for r in messy_rows()]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


VECTORS = "vec_id long, embedding array<float>, label int"
VECTOR_CLASHING = (
    "rank string, block string, chunk string, planes string, codes string, code string, "
    "error string, query string, score string, dims string, row string, other string"
)


def messy_vectors(n=400, dims=16, seed=3):
    """Sound rows: clusters, a vector that a third of all rows hold, ties; then unsound ones."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centres[0]
        else:
            v = [x + draw.gauss(0, 0.4) for x in centres[draw.randrange(12)]]
        norm = sum(x * x for x in v) ** 0.5
        rows.append((i - 20, [x / norm for x in v], draw.choice([0, 1, 2, 3])))
    nan, inf, some = float("nan"), float("inf"), rows[1][1]
    unsound = [
        (1000, None, 1), (1050, [], 1), (1100, [None] + some[1:], 2), (1150, [nan] + some[1:], 2),
        (1200, [inf] + some[1:], 3), (1250, some[1:] + [-inf], 3),
    ]
    return rows, unsound


@pytest.fixture(scope="session")
def sound_rows():
    return messy_vectors()[0]


@pytest.fixture(scope="session")
def vectors(spark):
    sound, unsound = messy_vectors()
    return spark.createDataFrame(sound + unsound, VECTORS).repartition(5)


@pytest.fixture(scope="session")
def vectors_wide(spark):
    names = [c.split()[0] for c in VECTOR_CLASHING.split(", ")]
    sound, unsound = messy_vectors()
    rows = [(*r, *names) for r in sound + unsound]
    return spark.createDataFrame(rows, f"{VECTORS}, {VECTOR_CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)
