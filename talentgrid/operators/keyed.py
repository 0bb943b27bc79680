"""Operators on keys: first/last row per key, inserts, upserts, orphans.

``row_number() <= n`` lets Spark drop all but n rows per key before the shuffle
(WindowGroupLimit), so a key that holds a third of the rows sends only n rows per
map task to its reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                  rank_as: str | None = None) -> DataFrame:
    """The first n rows of every group in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank_as or "_rank"
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank_as else kept.drop(name)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def dedupe_earliest(jobs: DataFrame) -> DataFrame:
    """Of jobs equal in title, country, skills and salary bounds keep the earliest published.

    A missing date counts as latest; equal dates fall back to job_slug.
    """
    keys = ["title", "country", "skills", "salary_min", "salary_max"]
    require_columns(jobs, *keys, "published", "job_slug")
    return top_per_group(jobs, keys, [F.asc_nulls_last("published"), F.asc("job_slug")])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  order: Sequence[Column]) -> DataFrame:
    """Rows of ``incoming`` to append: first per key, none whose key is stored already."""
    fresh = top_per_group(incoming, keys, order)
    return fresh.join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def upsert_update(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  order: Sequence[Column]) -> DataFrame:
    """Insert or overwrite by key; within the batch the last row of a key wins.

    ``order`` puts the winning row first.
    """
    latest = top_per_group(incoming, keys, order)
    untouched = existing.join(latest.select(*keys), list(keys), "left_anti")
    return untouched.select(*existing.columns).unionByName(latest.select(*existing.columns))


def upsert_stamped(existing: DataFrame, incoming: DataFrame, keys: Sequence[str],
                   order: Sequence[Column], stamp: Column) -> DataFrame:
    """``upsert_update`` that sets updated_at_utc on overwritten rows only.

    A new row keeps the creation time as its update time.
    """
    known = existing.select(*keys, F.col("created_at_utc").alias("_created"))
    latest = top_per_group(incoming, keys, order).join(known, list(keys), "left")
    stamped = latest.withColumns(
        {
            "created_at_utc": F.coalesce("_created", stamp),
            "updated_at_utc": stamp,
        }
    )
    untouched = existing.join(latest.select(*keys), list(keys), "left_anti")
    return untouched.select(*existing.columns).unionByName(stamped.select(*existing.columns))


def union_keep_last(existing: DataFrame, new: DataFrame, keys: Sequence[str],
                    order: Sequence[Column]) -> DataFrame:
    """Stack both and keep the last row per key: new rows beat stored ones.

    ``order`` puts the last row of a side first.
    """
    stacked = existing.withColumn("_batch", F.lit(0)).unionByName(
        new.select(*existing.columns).withColumn("_batch", F.lit(1))
    )
    return top_per_group(stacked, keys, [F.desc("_batch"), *order]).drop("_batch")


def upsert_keep_last(existing: DataFrame, new: DataFrame, keys: Sequence[str],
                     order: Sequence[Column], success: str = "success") -> DataFrame:
    """``union_keep_last``, then only rows whose last state is a success."""
    return union_keep_last(existing, new, keys, order).where(F.col(success))


def unprocessed_keys(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``wanted`` that ``done`` does not hold."""
    return distinct_keys(wanted, key).join(done.select(key), key, "left_anti")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).dropna().distinct()


def write_classification_back(jobs: DataFrame, classified: DataFrame, key: str,
                              columns: Sequence[str]) -> DataFrame:
    """Update ``columns`` of jobs from ``classified`` by key; others keep what they have.

    Of repeated keys in ``classified`` the first by the columns' values counts.
    """
    once = top_per_group(classified.select(key, *columns), [key],
                         [F.asc_nulls_last(c) for c in columns])
    fresh = once.select(key, F.lit(True).alias("_hit"),
                        *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = jobs.join(fresh, key, "left")
    updated = {
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(
            F.col(c) if c in jobs.columns else F.lit(None)
        )
        for c in columns
    }
    return joined.withColumns(updated).drop("_hit", *[f"_new_{c}" for c in columns])


def orphan_count(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                 name: str) -> DataFrame:
    """How many child rows have no parent (a missing key has none either)."""
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    orphans = child.select(child_key).join(
        keys, F.col(child_key) == F.col("_parent_key"), "left_anti"
    )
    return orphans.agg(F.count(F.lit(1)).alias(name))


def listings_with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Every job with eight columns of its company, nulls where there is none."""
    c = companies.select(
        F.col("slug").alias("_company_slug"),
        F.col("name").alias("company_name"),
        F.col("logo").alias("company_logo"),
        F.col("url").alias("company_url"),
        F.col("description").alias("company_description"),
        F.col("linkedin_staff_count").alias("company_size"),
        F.col("year_founded").alias("company_year_founded"),
        "company_sector",
        "linkedin_follower_count",
    )
    return jobs.join(c, F.col("company_slug") == F.col("_company_slug"), "left").drop(
        "_company_slug"
    )


def cleaned_jobs(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """The 14 working columns of AI jobs joined to their company."""
    c = companies.select(
        F.col("slug").alias("_company_slug"), F.col("name").alias("company_name"),
        "company_sector",
    )
    joined = jobs.where(F.col("ai")).join(
        c, F.col("company_slug") == F.col("_company_slug"), "left"
    )
    return joined.select(
        F.col("slug").alias("job_slug"), "title", "skills", "seniority", "types", "country",
        "city", "salary_min", "salary_max", "salary_currency", "salary_period", "published",
        "company_name", "company_sector",
    )


def level_rank(level: Column) -> Column:
    """Position in the seniority order, null for an unknown level."""
    order = F.array(*[F.lit(x) for x in fv.SENIORITY_ORDER])
    return F.nullif(F.array_position(order, level), F.lit(0).cast("long"))
