"""Mixing to target weights: iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import no_null
from talentgrid.llm.quality import words_of
from talentgrid.session import settle

MARGINS = ("source", "lang", "topic")
SWEEPS, FLATTENING, TOPICS = 10, 0.5, 8
#: The share of all tokens that the query keeps in expectation.
SHARE = 0.5
#: With a token budget, values below this share of all tokens are one level of their margin.
LEAST_SHARE = 0.001
#: The name of that level; no value is called so ("" or "=..." or a digit).
POOLED = "*"


def topic_of(words: Column) -> Column:
    """A stand-in topic from the text: the hash bucket of its longest word.

    Ties go to the last word in binary order; a text without words has topic 0.
    """
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    word = F.coalesce(longest["w"], F.lit(""))
    bucket = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % TOPICS
    return F.when(word == "", F.lit("0")).otherwise(bucket.cast("string"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null ids have ''."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def flattened_targets(cells: DataFrame, margin: str, power: float = FLATTENING) -> DataFrame:
    """Target shares of a margin: its shares of tokens to a power, made to sum to 1.

    One row per value of the margin; the total is added back through a grouped sum.
    """
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("part"))
    total = sums.agg(F.sum("part")).first()[0]
    return sums.select(margin, (F.col("part") / F.lit(float(total or 1.0))).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS
) -> DataFrame:
    """The cells (margins, tokens) with ``weight``: tokens fitted to all target shares.

    Each sweep scales the weights to one margin after the other: a grouped sum, joined
    back, never a window over all cells of a value. The cell table has one row for each
    combination that occurs and is written once a sweep, which cuts the lineage. Values
    without a target keep no weight; targets without a cell can't be met and stay out.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
    current = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for margin, shares in targets.items():
            sums = current.groupBy(margin).agg(F.sum("weight").alias("__sum"))
            factor = sums.join(shares, margin, "left").select(
                margin,
                F.when(F.col("__sum") > 0, F.coalesce("share", F.lit(0.0)) * F.lit(total) / F.col("__sum"))
                .otherwise(0.0).alias("__factor"),
            )
            current = current.join(factor, margin).withColumn(
                "weight", F.col("weight") * F.col("__factor")
            ).select(*cells.columns, "weight")
        current = settle(current, "raked")
    return current


def _value(name: str) -> Column:
    """A margin's value as text that joins; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def _weighed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, with margins and tokens of each row."""
    words = words_of(no_null())
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        _value("source").alias("__source"), _value("lang").alias("__lang"),
        words.alias("__words"),
    ).select(
        *[F.col(f"`{c}`") for c in keep], "__source", "__lang",
        topic_of(F.col("__words")).alias("__topic"),
        (F.size("__words") + 1).cast("long").alias("__tokens"),
    )


_CELL = {"__source": "source", "__lang": "lang", "__topic": "topic"}


def _pooled(cells: DataFrame, total: float) -> DataFrame:
    """The cells with a ``__<margin>`` more: the value, or POOLED where its tokens are few.

    Each margin has one row per value, joined back, so any number of values will do.
    """
    for margin in MARGINS:
        level = F.when(F.sum("tokens") < F.lit(LEAST_SHARE * total), POOLED).otherwise(F.col(margin))
        levels = cells.groupBy(margin).agg(level.alias(f"__{margin}"))
        cells = cells.join(levels, margin)
    return cells


def _fitted(cells: DataFrame, targets: dict[str, DataFrame] | None, sweeps: int) -> DataFrame:
    return rake(cells, targets or {m: flattened_targets(cells, m) for m in MARGINS}, sweeps)


def budget_scale(cells: DataFrame, budget: float) -> float:
    """The factor by which weights per token give ``budget`` expected tokens, cut at 1.

    The kept tokens are concave in the factor and linear between the cells' own
    ratios, so Newton's steps from below never pass the answer and end on its line.
    Where all cells with a weight together have fewer tokens, all of them stay whole.
    """
    ratio = F.col("weight") / F.col("tokens")
    weighted = cells.where("weight > 0").select("tokens", ratio.alias("ratio"))
    scale = 0.0
    while True:
        whole = F.col("ratio") * F.lit(scale) >= 1
        row = weighted.agg(
            F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("whole"),
            F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("ratio"))).alias("part"),
        ).first()
        if not row["part"]:
            return scale
        further = max(0.0, budget - float(row["whole"])) / float(row["part"])
        if further <= scale * (1 + 1e-12):
            return scale
        scale = further


def _probabilities(
    weighed: DataFrame, targets: dict[str, DataFrame] | None, sweeps: int, share: float | None
) -> DataFrame:
    """One row per cell: tokens, weight per token, and the chance to stay.

    Without ``share`` the chance is the weight over the highest one. With it, the
    expected kept tokens are that share of all, and cells beyond 1 stay whole.
    """
    if share is not None and not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    cells = settle(
        weighed.groupBy(*[F.col(a).alias(b) for a, b in _CELL.items()]).agg(
            F.sum("__tokens").alias("tokens")
        ),
        "cells",
    )
    ratio = F.col("weight") / F.col("tokens")
    if share is None:
        fitted = _fitted(cells, targets, sweeps)
        highest = float(fitted.agg(F.max(ratio)).first()[0] or 1.0)
        chances = ratio / F.lit(highest)
    else:
        total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
        if targets:
            fitted = _fitted(cells, targets, sweeps)
        else:
            levels = [F.col(f"__{m}").alias(m) for m in MARGINS]
            named = settle(_pooled(cells, total), "pooled")
            pooled = settle(named.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "levels")
            # All cells of a level get the level's weight per token.
            each = _fitted(pooled, None, sweeps).select(
                *[F.col(m).alias(f"__{m}") for m in MARGINS], ratio.alias("__ratio")
            )
            fitted = settle(
                named.join(each, [f"__{m}" for m in MARGINS]).select(
                    *MARGINS, "tokens", (F.col("tokens") * F.col("__ratio")).alias("weight")
                ),
                "fitted",
            )
        chances = F.least(F.lit(1.0), ratio * F.lit(budget_scale(fitted, share * total)))
    return fitted.select(*MARGINS, "tokens", ratio.alias("weight"), chances.alias("probability"))


def _sampled(weighed: DataFrame, cells: DataFrame, doc_id: Column, seed: str) -> DataFrame:
    named = weighed.withColumnsRenamed(_CELL)
    return named.join(cells.drop("tokens"), list(MARGINS)).withColumn(
        "kept", chance(doc_id, seed) < F.col("probability")
    )


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = "mix:",
    sweeps: int = SWEEPS, share: float | None = None,
) -> DataFrame:
    """doc_id, topic, n_tokens, weight, probability and kept of every row.

    Tokens here are words plus one. ``targets`` gives a table (margin, share) for each
    of source, lang and topic, by default flattened shares of the table itself. The
    weight per token is fitted for all documents; a document stays with a probability in
    proportion to it, 1 where it is highest, so the kept tokens have the target shares in
    expectation. So a single rare cell sets the size of the sample; with ``share`` the
    expected kept tokens are that share of all tokens instead: cells whose chance would be
    above 1 stay whole, the others make up for it, values below ``LEAST_SHARE`` of the
    tokens are one level of the flattened targets, and ``achieved_margins`` says how far
    the cut at 1 leaves the shares from their targets. Values in ``targets`` carry a leading "="; null is the empty text. The
    decision follows from doc_id, so repeated rows stay or go together. An empty table
    gives no row.
    """
    weighed = settle(_weighed(docs.select("doc_id", "text", "source", "lang"), ["doc_id"]), "weighed")
    cells = _probabilities(weighed, targets, sweeps, share)
    return _sampled(weighed, cells, F.col("doc_id"), seed).select(
        "doc_id", "topic", F.col("__tokens").alias("n_tokens"),
        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept",
    )


def sample_mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = "mix:",
    sweeps: int = SWEEPS, share: float | None = None,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns."""
    cells = _probabilities(_weighed(docs, []), targets, sweeps, share)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text", "source", "lang"
    )
    kept = _sampled(_weighed(packed, ["__row"]), cells, F.col("__row.doc_id"), seed)
    return kept.where("kept").select("__row.*")


def achieved_margins(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS,
    share: float | None = None,
) -> DataFrame:
    """margin, value, tokens, kept_tokens, wanted_share and kept_share of every value.

    ``kept_tokens`` are expected ones. ``wanted_share`` is what the fit asks for before
    chances are cut at 1, so the two shares differ by what there was too little of.
    """
    cells = settle(_probabilities(_weighed(docs, []), targets, sweeps, share), "margins")
    kept, wanted = F.col("tokens") * F.col("probability"), F.col("tokens") * F.col("weight")
    all_kept, all_wanted = cells.agg(F.sum(kept), F.sum(wanted)).first()
    values = F.inline(F.array(*[
        F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS
    ]))
    return cells.select(values, "tokens", kept.alias("kept"), wanted.alias("wanted")).groupBy(
        "margin", "value"
    ).agg(
        F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept_tokens"),
        (F.sum("wanted") / F.lit(float(all_wanted or 1.0))).alias("wanted_share"),
        (F.sum("kept") / F.lit(float(all_kept or 1.0))).alias("kept_share"),
    )
