"""SQL for the operators of this package that SQL can express."""

from __future__ import annotations

from talentgrid.llm import mixing, quality

_WS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '')"


def _dropped(pattern: str, kept: str = "") -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '{kept}', 'g'))"


def quality_sql() -> str:
    """Counts, votes, the estimation unrolled round by round, and the verdict."""
    rules = len(quality.RULES)
    votes = ", ".join(
        f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in quality.RULES
    )
    parts = [
        f"worded AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents)",
        "windows AS (SELECT r, i, list_slice(words, i, i + 2) AS w FROM worded, "
        "unnest(range(1, len(words) - 1)) AS u(i))",
        "twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1)",
        "covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r)",
        f"lined AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '{_WS}', '', 'g')) <> '') "
        "AS lines FROM worded)",
        f"""counted AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
            length(array_to_string(words, '')) AS word_chars, {_dropped('[#*$%&|<>]')} AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, {_dropped(chr(92) + 'p{Lu}')} AS n_upper,
            {_dropped('[#*$%&|<>!]+([' + _WS[1:-2] + ']|$)', chr(92) + '1')} AS n_marked
            FROM worded JOIN lined USING (r) LEFT JOIN covered c USING (r))""",
        f"voted AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{votes}] AS votes FROM counted)",
        "patterns AS MATERIALIZED (SELECT votes, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY votes)",
        f"state0 AS (SELECT {quality.GOOD_SHARE} AS good, list_resize([CAST({quality.RIGHT_ON_GOOD} AS DOUBLE)], {rules}, "
        f"{quality.RIGHT_ON_GOOD}) AS g, list_resize([CAST({quality.RIGHT_ON_BAD} AS DOUBLE)], {rules}, {quality.RIGHT_ON_BAD}) AS b)",
    ]
    odds = (
        "ln(good) - ln(1 - good) + list_sum(list_transform(range(1, {n}), lambda i: CASE votes[i] "
        "WHEN 1 THEN ln(g[i]) - ln(1 - b[i]) WHEN -1 THEN ln(1 - g[i]) - ln(b[i]) ELSE 0.0 END))"
    ).format(n=rules + 1)

    def share(i: int, sign: int, mass: str) -> str:
        return (
            f"(sum(CASE WHEN votes[{i}] = {sign} THEN {mass} ELSE 0 END) + sum(n) * {quality.PRIOR} * "
            f"{quality.RIGHT_ON_GOOD if sign == 1 else quality.RIGHT_ON_BAD} + 1) / "
            f"(sum(CASE WHEN votes[{i}] <> 0 THEN {mass} ELSE 0 END) + sum(n) * {quality.PRIOR} + 2)"
        )

    for k in range(quality.ROUNDS):
        parts.append(f"post{k} AS MATERIALIZED (SELECT votes, n, 1 / (1 + exp(-({odds}))) AS q FROM patterns, state{k})")
        good = ", ".join(share(i, 1, "n * q") for i in range(1, rules + 1))
        bad = ", ".join(share(i, -1, "n * (1 - q)") for i in range(1, rules + 1))
        parts.append(
            f"state{k + 1} AS MATERIALIZED (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS good, [{good}] AS g, [{bad}] AS b FROM post{k})"
        )
    parts.append(
        f"model AS (SELECT votes, round(1 / (1 + exp(-({odds}))), 6) AS posterior FROM patterns, state{quality.ROUNDS})"
    )
    return "WITH " + ",\n".join(parts) + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior,
            NOT base_failed AND posterior >= 0.5 AS kept FROM voted JOIN model USING (votes)"""


def mixing_sql() -> str:
    """Cells, levels, targets, every scaling step of the fit, the budget, and the draw."""
    value = "coalesce('=' || CAST({0} AS VARCHAR), '') AS {0}"
    parts = [
        f"worded AS (SELECT doc_id, {value.format('source')}, {value.format('lang')}, {_WORDS} AS words FROM documents)",
        "longest AS (SELECT *, list_sort(list_transform(words, lambda w: {'n': length(w), 'w': w}), 'DESC')[1].w AS word FROM worded)",
        f"""weighed AS (SELECT doc_id, source, lang, len(words) + 1 AS tokens, CASE WHEN word IS NULL THEN '0'
            ELSE CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {mixing.TOPICS} AS VARCHAR) END AS topic FROM longest)""",
        "found AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM weighed GROUP BY ALL)",
        "every AS MATERIALIZED (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM found)",
    ]
    # Values of few tokens are one level of their margin.
    for m in mixing.MARGINS:
        parts.append(
            f"level_{m} AS MATERIALIZED (SELECT {m}, CASE WHEN sum(tokens) < {mixing.LEAST_SHARE} * any_value(total) "
            f"THEN '{mixing.POOLED}' ELSE {m} END AS l_{m} FROM found, every GROUP BY {m})"
        )
    parts += [
        "named AS MATERIALIZED (SELECT * FROM found JOIN level_source USING (source) JOIN level_lang USING (lang) "
        "JOIN level_topic USING (topic))",
        "w0 AS MATERIALIZED (SELECT l_source AS source, l_lang AS lang, l_topic AS topic, CAST(sum(tokens) AS BIGINT) AS tokens, "
        "CAST(sum(tokens) AS DOUBLE) AS weight FROM named GROUP BY ALL)",
    ]
    for m in mixing.MARGINS:
        parts.append(
            f"target_{m} AS MATERIALIZED (SELECT {m}, part / (sum(part) OVER ()) AS share FROM "
            f"(SELECT {m}, pow(sum(tokens), {mixing.FLATTENING}) AS part FROM w0 GROUP BY {m}))"
        )
    step = 0
    for _ in range(mixing.SWEEPS):
        for m in mixing.MARGINS:
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT c.* REPLACE (weight * share * (SELECT sum(tokens) FROM w0) / s AS weight) "
                f"FROM w{step} c JOIN (SELECT {m}, sum(weight) AS s FROM w{step} GROUP BY {m}) USING ({m}) JOIN target_{m} USING ({m}))"
            )
            step += 1
    # The chance is the ratio times one factor, cut at 1: of the cells by falling ratio those
    # before the first that stays below 1 are whole, and the factor shares out the rest.
    parts += [
        f"""rated AS MATERIALIZED (SELECT n.source, n.lang, n.topic, n.tokens, w.weight / w.tokens AS ratio FROM named n
            JOIN w{step} w ON w.source = l_source AND w.lang = l_lang AND w.topic = l_topic)""",
        f"""factors AS (SELECT ratio, ({mixing.SHARE} * total - coalesce(sum(tokens) OVER (ORDER BY ratio DESC
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
            / sum(tokens * ratio) OVER (ORDER BY ratio DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
            FROM rated, every WHERE ratio > 0)""",
        "scale AS MATERIALIZED (SELECT factor FROM factors WHERE factor * ratio < 1 ORDER BY ratio DESC LIMIT 1)",
        "cells AS (SELECT source, lang, topic, ratio, least(1.0, ratio * factor) AS p FROM rated, scale)",
    ]
    draw = "CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / pow(16, 13)"
    return "WITH " + ",\n".join(parts) + f"""
        SELECT doc_id, topic, w.tokens AS n_tokens, round(ratio, 6) AS weight, round(p, 6) AS probability, {draw} < p AS kept
        FROM weighed w JOIN cells USING (source, lang, topic)"""


_SOUND = (
    "embedding IS NOT NULL AND len(embedding) > 0 "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)


def _floored(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))"


def negatives_sql() -> str:
    """All scores of the anchors by inner products of whole numbers, then ranks."""
    return f"""
        WITH rows_ AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                {_floored(256)} AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_SOUND}),
        scored AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 3"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds unrolled: every part against every entry, as whole numbers in doubles."""
    steps = [
        f"""rows_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
            vec_id, label, {_floored(4096)} AS v FROM embeddings WHERE {_SOUND})""",
        f"""parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x
            FROM rows_, range({parts}) AS t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts JOIN rows_ USING (r) "
        f"WHERE r <= {entries} AND vec_id IS NOT NULL)",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""given{k} AS MATERIALIZED (SELECT r, p, e, d, x FROM (SELECT r, p, e, x, list_inner_product(x, x)
            - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN book{k} USING (p))
            QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
                SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n
                FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM given{k}) GROUP BY p, e, i) GROUP BY p, e) m
                USING (p, e))"""
            )
    steps += [
        f"""coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code,
            CAST(sum(d) AS BIGINT) AS error FROM given{rounds} GROUP BY r)""",
        f"""said AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h
            FROM (SELECT p, e, c, unnest(range(1, len(c) + 1)) AS i FROM book{rounds}))""",
    ]
    return f"""WITH {", ".join(steps)} SELECT vec_id, code, error,
        CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM coded JOIN rows_ USING (r), said"""


LLM_ORACLE = {
    "op7_mixing": mixing_sql(),
    "op8_quality_rules": quality_sql(),
    "op11_hard_negatives": negatives_sql(),
    "op13_vector_codes": codes_sql(),
}
