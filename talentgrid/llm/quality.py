"""Quality rules: votes, expectation-maximisation, posterior quality. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import BLANKS, no_null
from talentgrid.session import settle

ROUNDS = 30
# Fixed starting point of the estimation: how often a rule that votes is right. A rule
# knows one kind of junk: on other junk its good vote is wrong.
GOOD_SHARE, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.8, 0.98, 0.3
#: Made-up votes behind these accuracies, as a share of the documents. A rule that votes
#: seldom would else learn that its few bad votes fall on good documents.
PRIOR = 0.5

#: (rule, votes bad, votes good); neither: it abstains. Over the counts of a text.
RULES = (
    ("length", "n_words < 20", "n_words >= 100"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words AND n_words >= 50"),
    ("lines", "3 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines AND n_lines >= 5"),
    (
        "repeats", "10 * n_repeat_words > 3 * n_words",
        "10 * n_repeat_words <= n_words AND n_words >= 50",
    ),
    (
        "word length", "word_chars < 2 * n_words OR word_chars > 12 * n_words",
        "word_chars BETWEEN 3 * n_words AND 8 * n_words AND n_words >= 50",
    ),
    ("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars AND n_words >= 50"),
    (
        "marks", "4 * n_marked > n_words", "50 * n_marked <= n_words AND n_words >= 50",
    ),
)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though used several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six blanks."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, "[\\x20\\x09-\\x0D]+")
    )


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are sorted together with their places, so equal ones are neighbours; from
    the places of repeated windows, in order, each adds the words beyond the one before.
    Sorting keeps this at n log n for texts of any length.
    """
    n = F.size(words)

    def places(windows: Column) -> Column:
        count = F.size(windows)
        same = F.transform(
            F.arrays_zip(
                F.slice(windows, 1, count - 1).alias("a"), F.slice(windows, 2, count - 1).alias("b")
            ),
            lambda p: (p["a"]["x"] == p["b"]["x"])
            & (p["a"]["y"] == p["b"]["y"])
            & (p["a"]["z"] == p["b"]["z"]),
        )

        def chosen(flags: Column) -> Column:
            twice = F.arrays_zip(
                windows.alias("w"),
                F.concat(F.array(F.lit(False)), flags).alias("before"),
                F.concat(flags, F.array(F.lit(False))).alias("after"),
            )
            kept = F.filter(twice, lambda t: t["before"] | t["after"])
            return F.sort_array(F.transform(kept, lambda t: t["w"]["i"]))

        return _bound(same, chosen)

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            at, F.slice(F.concat(F.array(F.lit(-3)), at), 1, F.size(at)),
            lambda a, b: F.least(F.lit(3), a - b),
        )
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    windows = F.sort_array(
        F.arrays_zip(
            F.slice(words, 1, n - 2).alias("x"), F.slice(words, 2, n - 2).alias("y"),
            F.slice(words, 3, n - 2).alias("z"), F.sequence(F.lit(0), n - 3).alias("i"),
        )
    )
    return F.when(n < 4, F.lit(0)).otherwise(
        _bound(_bound(windows, places), covered)
    ).cast("long")


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The counts that rules read, beside the columns to keep; null text has no words."""
    text = no_null()
    words = docs.select(
        *[F.col(f"`{c}`") for c in keep], text.alias("__text"), words_of(text).alias("__words")
    )

    def left(name: str, pattern: str) -> Column:
        return F.length(name) - F.length(F.regexp_replace(name, pattern, ""))

    lines = F.filter(
        F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    )
    counted = words.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        left("__text", "[#*$%&|<>]").cast("long").alias("n_symbols"),
        _bound(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            ),
        ).alias("__lines"),
        _repeated_words(F.col("__words")).alias("n_repeat_words"),
        left("__text", "\\p{Lu}").cast("long").alias("n_upper"),
        left("__text", "[#*$%&|<>!]+(?=[\\x20\\x09-\\x0D]|$)").cast("long").alias("n_marked"),
    )
    return counted.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols",
        F.col("__lines.dup").alias("n_dup_lines"), "n_repeat_words",
        F.col("__lines.n").alias("n_lines"), "n_upper", "n_marked",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias(
            "base_failed"
        ),
    )


def votes(rules=RULES) -> Column:
    """One vote per rule: -1 bad, 1 good, 0 abstains."""
    return F.array(
        *[
            F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
            for _, bad, good in rules
        ]
    )


def _log_odds(votes_: Column, state: Column) -> Column:
    """Log odds of good after the votes; a rule that abstains says nothing."""
    seen = F.arrays_zip(
        votes_.alias("v"), state["on_good"].alias("g"), state["on_bad"].alias("b")
    )
    each = F.transform(
        seen,
        lambda r: F.when(r["v"] == 1, F.log(r["g"]) - F.log(1 - r["b"]))
        .when(r["v"] == -1, F.log(1 - r["g"]) - F.log(r["b"]))
        .otherwise(0.0),
    )
    prior = F.log(state["good"]) - F.log(1 - state["good"])
    return F.aggregate(each, prior, lambda s, x: s + x)


def _posterior(votes_: Column, state: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes_, state)))


def _next_state(patterns: Column, state: Column, rules: int) -> Column:
    """One round: posteriors of all patterns, then shares and accuracies. ``PRIOR`` adds
    votes of the starting accuracies, and one right and one wrong vote keep all off 0 and 1."""

    def total(weighed: Column, value) -> Column:
        return F.aggregate(weighed, F.lit(0.0), lambda s, p: s + value(p))

    def estimate(weighed: Column) -> Column:
        behind = total(weighed, lambda p: p["n"]) * PRIOR

        def share(i: int, sign: int, mass) -> Column:
            right = total(
                weighed, lambda p: F.when(F.get(p["votes"], F.lit(i)) == sign, mass(p)).otherwise(0.0)
            )
            voted = total(
                weighed, lambda p: F.when(F.get(p["votes"], F.lit(i)) != 0, mass(p)).otherwise(0.0)
            )
            start = RIGHT_ON_GOOD if sign == 1 else RIGHT_ON_BAD
            return (right + behind * start + 1) / (voted + behind + 2)

        good = lambda p: p["n"] * p["q"]
        bad = lambda p: p["n"] * (1 - p["q"])
        return F.struct(
            ((total(weighed, good) + 1) / (total(weighed, lambda p: p["n"]) + 2)).alias("good"),
            F.array(*[share(i, 1, good) for i in range(rules)]).alias("on_good"),
            F.array(*[share(i, -1, bad) for i in range(rules)]).alias("on_bad"),
        )

    weighed = F.transform(
        patterns,
        lambda p: F.struct(
            p["votes"].alias("votes"), p["n"].alias("n"),
            _posterior(p["votes"], state).alias("q"),
        ),
    )
    return _bound(weighed, estimate)


def quality_model(voted: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """(votes, posterior) for every pattern of votes that occurs.

    Documents only matter through their pattern, of which there are 3 to the number of
    rules at most; so patterns are counted over all documents, and the estimation runs
    on that short list in one expression.
    """
    n = len(rules)
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    listed = counted.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    start = F.struct(
        F.lit(GOOD_SHARE).alias("good"),
        F.array_repeat(F.lit(RIGHT_ON_GOOD), n).alias("on_good"),
        F.array_repeat(F.lit(RIGHT_ON_BAD), n).alias("on_bad"),
    )
    fitted = listed.withColumn(
        "state",
        F.aggregate(
            F.sequence(F.lit(1), F.lit(rounds)), start,
            lambda state, _: _next_state(F.col("patterns"), state, n),
        ),
    )
    each = fitted.select("state", F.explode("patterns").alias("p"))
    return each.select(
        F.col("p.votes").alias("votes"),
        F.round(_posterior(F.col("p.votes"), F.col("state")), 6).alias("posterior"),
    )


def _judged(voted: DataFrame, model: DataFrame) -> DataFrame:
    # 3 to the number of rules rows at most. The verdict is one expression over both
    # sides: as two conditions, the base rule's would be pushed below the join and count
    # every text once more.
    return voted.join(F.broadcast(model), "votes").withColumn(
        "kept",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("posterior") >= 0.5),
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept of every row.

    Null or blank texts have no words and fail the base rule. Rows are judged one by
    one, so repeated ids and texts each get their own equal result; an empty table
    gives no row. Counts are stored once: the model and the result both read them.
    """
    voted = settle(
        text_counts(docs, ["doc_id"]).withColumn("votes", votes()), "quality-counts"
    )
    return _judged(voted, quality_model(voted)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "posterior", "kept",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Every row is stored with its votes, so texts are counted once; the model reads the
    votes alone, and no text is shuffled.
    """
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = numbered.withColumn("text", F.col("__row.text"))
    counted = text_counts(rows, ["__row"]).select("__row", "base_failed", votes().alias("votes"))
    voted = settle(counted, "voted-rows")
    model = settle(quality_model(voted), "quality-model")
    return _judged(voted, model).where("kept").select("__row.*")
