"""Column functions over posting text: countries, titles, employment terms, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv

# Case-insensitive with Unicode word boundaries and spaces.
_WORDS = r"(?iU)\b(?:%s)\b"
_ASCII_SPACE = " \t\n\r\f\x0b"


def first_match(cases: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """``CASE WHEN`` over (condition, label) pairs in order."""
    head, *rest = cases
    chain = reduce(
        lambda acc, case: acc.when(case[0], F.lit(case[1])), rest, F.when(head[0], F.lit(head[1]))
    )
    return chain if otherwise is None else chain.otherwise(otherwise)


def has_word(text: Column, alternatives: str) -> Column:
    return text.rlike(_WORDS % alternatives)


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(_ASCII_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(stripped(text) != "", text)


def capitalize_words(text: Column) -> Column:
    """Upper-case the first letter of every run of letters and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def standardize_country(raw: Column) -> Column:
    """Raw country text -> canonical, title-cased country; 'Unknown' when there is none.

    Rules are tried in order on the original text. Only text no rule matched is
    cut at the first ':' and then at the first ';'.
    """
    rules = [(F.lower(raw).rlike(fv.UNITED_STATES_PATTERN), "United States")]
    rules += [(has_word(raw, words), name) for name, words in fv.COUNTRY_RULES]
    uncut = F.when(raw.contains(":"), F.trim(F.split_part(raw, F.lit(":"), F.lit(1)))).otherwise(raw)
    cut = F.when(
        uncut.contains(";"), F.trim(F.split_part(uncut, F.lit(";"), F.lit(1)))
    ).otherwise(uncut)
    known = F.when(
        (F.trim(cut) != "") & ~F.upper(cut).isin("[ ]", "UNKNOWN"), cut
    ).otherwise(F.lit("Unknown"))
    return F.trim(capitalize_words(first_match(rules, known)))


def extract_seniority(title: Column) -> Column:
    patterns = [(has_word(title, words), level) for level, words in fv.SENIORITY_PATTERNS]
    missing = title.isNull() | (stripped(title) == "")
    return F.when(missing, F.lit("Unknown")).otherwise(
        first_match(patterns, F.lit("Unspecified"))
    )


def _employment_text(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), r"(?U)[^a-zA-Z\s,;/-]", " ")


def employment_text_of(types: Column) -> Column:
    """The one text a list of employment types is judged by: its first element."""
    return F.try_element_at(types, F.lit(1))


def job_type(raw: Column) -> Column:
    """internship > full_time > part_time > contract; null when nothing matches."""
    text = _employment_text(raw)
    cases = [(has_word(text, "|".join(fv.INTERNSHIP_TERMS)), "internship")]
    cases += [(has_word(text, "|".join(terms)), name) for name, terms in fv.JOB_TYPE_TERMS]
    return first_match(cases)


def work_mode(raw: Column) -> Column:
    """remote > hybrid > onsite; null when nothing matches."""
    text = _employment_text(raw)
    return first_match(
        [(has_word(text, "|".join(terms)), name) for name, terms in fv.WORK_MODE_TERMS]
    )


def url_is_valid(url: Column, bare_redirect: str | None = None) -> Column:
    """True when scheme and host are there and the URL is not the bare redirect address."""
    shaped = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+")
    host = F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)
    brackets_pair = host.contains("[") == host.contains("]")
    valid = F.coalesce(shaped & brackets_pair, F.lit(False))
    return valid if bare_redirect is None else valid & (url != bare_redirect)


def url_type(url: Column, bare_redirect: str | None = None) -> Column:
    marks = [(F.lower(url).contains(mark), name) for name, mark in fv.URL_TYPE_MARKS]
    return F.when(url_is_valid(url, bare_redirect), first_match(marks, F.lit("web"))).otherwise(
        F.lit("invalid")
    )


def compose_location(location: Column, city: Column, country: Column) -> Column:
    """The given location, else 'city, country', else whichever exists, else ''."""
    parts = F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit("")))
    return F.coalesce(F.nullif(location, F.lit("")), parts)
