"""Column functions over skill lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.functions.text import stripped


def split_csv(text: Column) -> Column:
    """Comma text -> trimmed non-empty parts; null or blank -> []."""
    parts = F.filter(F.transform(F.split(text, ","), stripped), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def parse_skill_list(text: Column) -> Column:
    """A bracketed list literal or comma text -> array; null or blank -> []."""
    trimmed = stripped(text)
    literal = F.when(
        trimmed.startswith("[") & trimmed.endswith("]"), F.from_json(trimmed, "array<string>")
    )
    return F.coalesce(literal, split_csv(text))


def normalize_skills(skills: Column) -> Column:
    """Lower-cased, trimmed, non-blank skills, each once."""
    cleaned = F.transform(skills, lambda x: stripped(F.lower(x)))
    return F.array_except(cleaned, F.array(F.lit(""), F.lit(None).cast("string")))


def names_any_skill(skills: Column) -> Column:
    """Whether normalizing leaves a skill; stops at the first one."""
    return F.exists(skills, lambda x: stripped(x) != "")


def remove_generic_skills(skills: Column) -> Column:
    """Drop generic skills; order and repeats stay, null stays null."""
    return F.filter(skills, lambda x: ~x.isin(fv.GENERIC_SKILLS))


def skills_count(skills: Column) -> Column:
    return F.when(skills.isNull(), F.lit(0)).otherwise(F.size(skills))


def category_map() -> Column:
    pairs = [
        F.lit(text)
        for category, skills in fv.SKILL_CATEGORIES.items()
        for skill in skills
        for text in (skill, category)
    ]
    return F.create_map(*pairs)


def skill_category(skill: Column) -> Column:
    """Category of a skill, null when it has none."""
    return F.try_element_at(category_map(), F.lower(skill))


def pair_domain_label(skill_1: Column, skill_2: Column) -> Column:
    first = F.coalesce(skill_category(skill_1), F.lit("Other"))
    second = F.coalesce(skill_category(skill_2), F.lit("Other"))
    return F.when(first == second, F.concat(F.lit("Same Domain: "), first)).otherwise(
        F.concat(F.lit("Cross-Domain: "), first, F.lit(" + "), second)
    )
