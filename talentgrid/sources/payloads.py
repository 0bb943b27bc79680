"""Nested posting payloads to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.functions.dates import parse_moment
from talentgrid.functions.skills import split_csv
from talentgrid.functions.text import compose_location
from talentgrid.operators.keyed import top_per_group
from talentgrid.session import settle
from talentgrid.sources import schemas

SKILL_FIELDS = {
    "skills": "technical", "soft_skills": "soft", "tools": "tool", "languages": "language",
    "frameworks": "framework", "libraries": "library",
}


def _unread(json: str, parsed: Column) -> Column:
    """Why a text gave nothing, or null if it did."""
    return (
        F.when(F.trim(F.coalesce(json, F.lit(""))) == "", "empty")
        .when(parsed.isNotNull(), None)
        .when(F.try_parse_json(json).isNull(), "no JSON")
        .otherwise("other JSON")
    )


def classified_entries(pages: DataFrame, json: str, order: str) -> DataFrame:
    """Every entry of every page, and every page that can't be read, with a reason.

    ``reason`` is null for a whole entry. A page is rejected as "empty", "no JSON" or
    "other JSON" (no list of entries), an entry for "no job", "no company" or "no slug".
    ``length`` has the characters of the page. A page is parsed once.
    """
    parsed = pages.select(
        order, F.length(json).alias("length"), F.from_json(json, schemas.PAYLOAD).alias("_entries"),
        F.col(json).alias("_text"),
    )
    entries = parsed.select(
        order, "length", _unread("_text", F.col("_entries")).alias("_page"),
        F.posexplode_outer("_entries").alias("_at", "entry"),
    ).where(F.col("_page").isNotNull() | F.col("_at").isNotNull())
    shaped = entries.select(
        F.struct(order, "_at").alias("ordinal"), "length", "_page",
        F.col("entry.job").alias("job"), F.col("entry.company").alias("company"),
        F.col("entry.location").alias("location"), F.col("entry.types").alias("types"),
    )
    reason = (
        F.when(F.col("_page").isNotNull(), F.col("_page"))
        .when(~_holds_anything(shaped, "job"), "no job")
        .when(~_holds_anything(shaped, "company"), "no company")
        .when(F.coalesce("job.slug", F.lit("")) == "", "no slug")
    )
    return shaped.withColumn("reason", reason).drop("_page")


def payload_entries(pages: DataFrame, json: str, order: str) -> DataFrame:
    """One row per posting entry of each page, entries lacking job or company left out.

    One without a slug names its company, but is no job.
    """
    classified = classified_entries(pages, json, order)
    return classified.where(F.col("reason").isNull() | (F.col("reason") == "no slug")).drop(
        "length", "reason"
    )


def rejected_entries(pages: DataFrame, json: str, order: str) -> DataFrame:
    """(page, entry, reason, length): what gave no job row; entry is null for a whole page."""
    rejected = classified_entries(pages, json, order).where(F.col("reason").isNotNull())
    return rejected.select(
        F.col(f"ordinal.{order}").alias(order), F.col("ordinal._at").alias("entry"), "reason", "length"
    )


def _holds_anything(df: DataFrame, struct: str) -> Column:
    """False for a null or empty object."""
    empty = F.from_json(F.lit("{}"), df.schema[struct].dataType)
    return F.col(struct).isNotNull() & ~F.col(struct).eqNullSafe(empty)


def employment_types(kind: Column, types: Column) -> Column:
    """The comma text if there is one, else the given list, else []."""
    given = F.coalesce(types, F.array().cast("array<string>"))
    return F.when(F.coalesce(kind, F.lit("")) != "", split_csv(kind)).otherwise(given)


def jobs_from_entries(entries: DataFrame) -> DataFrame:
    """Rows of the jobs table; entries without a slug are left out."""
    job = F.col("job")
    text = F.lit("")
    city, country = F.coalesce(job["city"], text), F.coalesce(job["country"], text)
    plain = ("title", "description", "status", "roles", "seniority", "salary_currency",
             "salary_period", "benefits", "beneficial", "experience", "ideal_candidate",
             "qualifications", "schema", "force_status")
    return entries.where(F.coalesce(job["slug"], text) != "").select(
        job["slug"].alias("slug"),
        F.col("company.slug").alias("company_slug"),
        *[job[name].alias(name) for name in plain],
        *[F.coalesce(job[name], F.lit(False)).alias(name) for name in ("premium", "ai")],
        *[parse_moment(job[name]).alias(name) for name in ("created_at", "published", "pin_until")],
        *[split_csv(job[name]).alias(name) for name in SKILL_FIELDS],
        employment_types(job["type"], F.col("types")).alias("types"),
        city.alias("city"), country.alias("country"),
        compose_location(F.col("location"), city, country).alias("location"),
        *[F.coalesce(job[name], F.lit(0)).alias(name)
          for name in ("salary_min", "salary_max", "same_as")],
    )


def companies_from_entries(entries: DataFrame) -> DataFrame:
    """The first row of every company slug, in payload order."""
    named = entries.where(F.coalesce(F.col("company.slug"), F.lit("")) != "").select(
        "ordinal", "company.*"
    )
    first = top_per_group(named, ["slug"], [F.asc("ordinal")])
    return first.drop("ordinal").fillna(0, ["jobs_count", "jobs_ai_count"])


def unpivot_skill_arrays(jobs: DataFrame, slug: str = "slug") -> DataFrame:
    """(job_slug, skill_name, skill_category) rows from the six skill arrays."""
    arrays = F.array(
        *[F.struct(F.lit(category).alias("skill_category"), F.col(name).alias("names"))
          for name, category in SKILL_FIELDS.items()]
    )
    lists = jobs.select(F.col(slug).alias("job_slug"), F.inline(arrays))
    return lists.select("job_slug", F.explode("names").alias("skill_name"), "skill_category").where(
        F.col("skill_name") != ""
    )


def distinct_skill_details(details: DataFrame) -> DataFrame:
    return details.select("job_slug", "skill_name", "skill_category").distinct()


def flatten_postings(pages: DataFrame, json: str, order: str) -> dict[str, DataFrame]:
    """companies, jobs, job_skills_detail and rejected entries of a payload, lazily.

    Every entry of a page is a job row or rejected.
    """
    entries = payload_entries(pages, json, order)
    jobs = jobs_from_entries(entries)
    return {
        "companies": companies_from_entries(entries),
        "jobs": jobs,
        "job_skills_detail": distinct_skill_details(unpivot_skill_arrays(jobs)),
        "rejected": rejected_entries(pages, json, order),
    }


def normalize_star(raw: DataFrame, json: str, order: str) -> dict[str, DataFrame]:
    """Seven normalized tables of the second source, first row per key, and rejected lines.

    Postings without an id, and repeats of one, are left out before anything else; the
    lines without one, or that can't be read, are in ``rejected``. The nested keys and names
    are parsed alone and staged for the six tables that read them; the texts of jobs are
    parsed for the jobs table, and no copy of them is stored. ``order`` tells lines apart.
    """
    whole = T.StructType.fromDDL(f"p {schemas.STAR_POSTING}")["p"].dataType
    lists = ("company", "types", "countries", "cities")

    def first_postings(*fields: str) -> DataFrame:
        kept = T.StructType([f for f in whole if f.name in ("id", *fields)])
        parsed = raw.select(F.col(order).alias("ordinal"), F.from_json(json, kept).alias("p"))
        identified = parsed.where(F.coalesce(F.col("p.id"), F.lit(0)) != 0)
        return top_per_group(identified.withColumn("id", F.col("p.id")), ["id"], [F.asc("ordinal")])

    postings = settle(first_postings(*lists), "star-postings")
    texts = first_postings("company", *[f.name for f in whole if f.name not in lists])
    texts = texts.withColumn("p", F.col("p").withField("company_id", F.col("p.company.id")))
    read = raw.select(
        F.col(order).alias("line"), F.col(json).alias("_text"), F.length(json).alias("length"),
        F.from_json(json, T.StructType([whole["id"]])).alias("p"),
    )
    reason = F.coalesce(
        _unread("_text", F.when(F.try_parse_json("_text").isNotNull(), F.col("p"))),
        F.when(F.coalesce(F.col("p.id"), F.lit(0)) == 0, "no id"),
    )
    rejected = read.select("line", reason.alias("reason"), "length").where("reason IS NOT NULL")

    def nested(field: str, key: str) -> DataFrame:
        items = postings.select("id", "ordinal", F.posexplode(f"p.{field}").alias("at", "item"))
        return items.where(F.coalesce(F.col(f"item.{key}"), F.lit(0)) != 0)

    def first(rows: DataFrame, key: str) -> DataFrame:
        order_by = [F.asc(c) for c in ("ordinal", "at") if c in rows.columns]
        return top_per_group(rows, [key], order_by).drop("ordinal", "at")

    types = nested("types", "id")
    countries = nested("countries", "id")
    cities = nested("cities", "geonameid")
    companies = postings.where(F.col("p.company").isNotNull()).select("ordinal", "p.company.*")
    item = F.col("item")
    return {
        "companies": first(companies, "id").fillna({"is_agency": False}),
        "types": first(
            types.select(item["id"].alias("id"), item["name"].alias("name"), "ordinal", "at"), "id"
        ),
        "job_to_types": types.select(
            F.col("id").alias("job_id"), item["id"].alias("type_id")
        ).distinct(),
        "countries": first(
            countries.select(
                item["id"].alias("id"), item["code"].alias("code"), item["name"].alias("name"),
                item["region"]["id"].alias("region_id"),
                item["region"]["name"].alias("region_name"), "ordinal", "at",
            ),
            "id",
        ),
        "locations": first(
            cities.select(
                item["geonameid"].alias("geonameid"), item["asciiname"].alias("asciiname"),
                item["name"].alias("name"), item["country"]["code"].alias("country_code"),
                item["state"]["code"].alias("state_code"), item["timezone"].alias("timezone"),
                item["latitude"].alias("latitude"), item["longitude"].alias("longitude"),
                F.coalesce(item["population"], F.lit(0)).alias("population"), "ordinal", "at",
            ),
            "geonameid",
        ),
        "job_locations": cities.select(
            F.col("id").alias("job_id"), item["geonameid"].alias("geonameid")
        ).distinct(),
        "rejected": rejected,
        "jobs": texts.select(
            "id",
            F.col("p.ext_id").alias("ext_id"), F.col("p.company_id").alias("company_id"),
            *[F.col(f"p.{c}").alias(c)
              for c in ("title", "location", "description", "experience_level",
                        "application_url", "language")],
            F.coalesce("p.has_remote", F.lit(False)).alias("has_remote"),
            parse_moment(F.col("p.published")).alias("published"),
            *[F.col(f"p.{c}").alias(c) for c in ("salary_min", "salary_max", "salary_currency")],
        ),
    }


def exchange_rate_rows(raw: DataFrame, key: str, json: str) -> DataFrame:
    """A JSON object of currency -> units per USD to rows; USD is always 1.

    ``rate_to_usd`` is what one unit is worth, so the stored value is 1/rate.
    """
    parsed = raw.select(key, F.from_json(json, "map<string,double>").alias("rates"))
    with_usd = F.map_concat(
        F.map_filter("rates", lambda k, v: (k != "USD") & (v != 0)),
        F.create_map(F.lit("USD"), F.lit(1.0)),
    )
    rows = parsed.select(key, F.explode(with_usd).alias("currency_code", "per_usd"))
    return rows.select(
        key, "currency_code",
        (F.lit(1.0) / F.col("per_usd")).cast("decimal(12,6)").alias("rate_to_usd"),
    )
