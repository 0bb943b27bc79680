"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.functions import dates, skills as skill_fns, text
from talentgrid.functions.money import annual_usd_salaries, with_usd_rate
from talentgrid.operators import (
    ecosystem, filters, groups, keyed, pairs, postings as base, quality, salaries, seniority,
    titles, trends,
)
from talentgrid.plans import cleaning, projection as P
from talentgrid.plans.trends import settled_series, settled_trends
from talentgrid.session import settle, shared_folder
from talentgrid.sources import keyed_table, payloads, tables
from talentgrid.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY_SKILLS = ["Python", "SQL", "Machine Learning", "AWS", "Tableau", "Spark"]
FILTERS = {
    "date_range": ("1996-01-01", "1999-06-01"),
    "country": "All",
    "standardized_title": "Data Engineer",
    "skills": ["Python", "Tableau"],
}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that the order of additions cannot show."""
    return df.select(
        *[
            (F.round(f.name, 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(spark, sf_dir))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return build


def stored_postings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns of the postings, stored: for reports that read them more than once."""
    return settle(P.postings(spark, sf_dir).select(*columns), "postings")


def joined_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


# Sources and sinks -----------------------------------------------------------------


def _cleaned_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = P.analysis_jobs(spark, sf_dir)
    return jobs.select(
        F.col("job_id").alias("job_slug"), F.col("standardized_title").alias("title"),
        F.to_json("skills").alias("skills"),
        "country", "published", "company_name", "salary_min", "salary_max", "job_type",
        "work_mode", "standardized_title", "seniority_level",
    )


@query
def scan_csv_postings(spark, sf_dir):
    folder = shared_folder(spark, "postings-csv")
    tables.write_csv(_cleaned_csv(spark, sf_dir), folder)
    return tables.read_csv_postings(spark, folder)


@query
def scan_parquet_pivot(spark, sf_dir):
    folder = shared_folder(spark, "pivot")
    tables.write_parquet(base.skill_pivot(P.postings(spark, sf_dir)), folder)
    return tables.read_parquet_table(spark, folder, "skill", "mentions").groupBy("skill").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("mentions").alias("mentions")
    )


@query
def scan_table(spark, sf_dir):
    P.raw_jobs(spark, sf_dir, skills=False).createOrReplaceTempView("jobs_raw")
    return joined_text(spark.sql("SELECT * FROM jobs_raw"), "types")


@query
def scan_distinct_keys(spark, sf_dir):
    folder = shared_folder(spark, "keys-csv")
    tables.write_csv(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), folder)
    keys = spark.read.schema("o_orderkey bigint, o_custkey bigint").option("header", True).csv(folder)
    return keyed.distinct_keys(keys, "o_custkey")


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a page of two entries, the second without a company."""
    orders = P.orders_in_full(spark, sf_dir)
    text_date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    job = F.struct(
        F.col("o_orderkey").cast("string").alias("slug"),
        P.raw_title().alias("title"),
        (F.col("c_acctbal") >= 0).alias("ai"),
        text_date.alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.lit("0001-01-01T00:00:00Z")).otherwise(
            text_date
        ).alias("published"),
        F.concat(F.array_join("skills", " , "), F.lit(", ,")).alias("skills"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("teamwork,")).alias("soft_skills"),
        F.when(F.col("o_orderstatus") == "F", P.type_text()).alias("type"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("city"),
        P.listed(P.RAW_COUNTRIES).alias("country"),
        *[c.alias(name) for name, c in P._salary_columns().items()],
    )
    company = F.struct(F.col("o_custkey").cast("string").alias("slug"),
                       F.col("c_name").alias("name"))
    given = F.array(F.lit("Remote"), F.lit("Freelancer"))
    place = F.when(F.col("n_nationkey") % 5 == 0, F.lit("Somewhere")).alias("location")
    full = F.struct(job.alias("job"), company.alias("company"), place, given.alias("types"))
    bare = F.struct(job.alias("job"), F.lit(None).cast(
        "struct<slug:string,name:string>").alias("company"), place, given.alias("types"))
    return orders.select(F.col("o_orderkey").alias("page"),
                         F.to_json(F.array(full, bare)).alias("payload"))


@query
def flatten_postings_json(spark, sf_dir):
    entries = payloads.payload_entries(_payload(spark, sf_dir), "payload", "page")
    jobs = payloads.jobs_from_entries(entries)
    return joined_text(jobs, "skills", "soft_skills", "types").select(
        "slug", "company_slug", "title", "premium", "ai", "created_at", "published", "skills",
        "soft_skills", F.size("tools").alias("n_tools"), "types", "city", "country", "location",
        "salary_min", "salary_max", "same_as",
    )


@query
def rejected_postings_json(spark, sf_dir):
    """Of the pages, every third cut short or no list; of the others the entry without a company."""
    pages = _payload(spark, sf_dir)
    half = F.substring("payload", F.lit(1), (F.length("payload") / 2).cast("int"))
    broken = F.when(F.col("page") % 2 == 0, half).otherwise(F.lit('"no list"'))
    pages = pages.withColumn("payload", F.when(F.col("page") % 3 == 0, broken).otherwise(F.col("payload")))
    return payloads.rejected_entries(pages, "payload", "page").select("page", "entry", "reason")


@query
def normalize_star_json(spark, sf_dir):
    orders = P.orders_in_full(spark, sf_dir, skills=False)
    nation = F.col("n_nationkey")
    doc = F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("id"), F.col("c_name").alias("name")).alias("company"),
        P.raw_title().alias("title"),
        F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).alias("ext_id"),
        F.col("o_orderpriority").alias("experience_level"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("has_remote"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        *[c.alias(name) for name, c in P._salary_columns().items()],
        F.array(
            F.struct(F.ascii("o_orderstatus").alias("id"), F.col("o_orderstatus").alias("name")),
            F.struct(F.ascii("o_orderpriority").alias("id"),
                     F.col("o_orderpriority").alias("name")),
        ).alias("types"),
        F.array(
            F.struct((nation + 1).alias("id"), F.col("n_name").alias("name"),
                     F.struct((nation % 5).alias("id")).alias("region"))
        ).alias("countries"),
        F.array(
            F.struct((nation + 100).alias("geonameid"), F.col("n_name").alias("name"),
                     F.struct(F.lit("XX").alias("code")).alias("country"))
        ).alias("cities"),
    )
    raw = orders.select(F.col("o_orderkey").alias("line"), F.to_json(doc).alias("doc"))
    star = payloads.normalize_star(raw, "doc", "line")
    out = None
    for name, rows in star.items():
        rows = rows.drop("length")
        # Every column in the table's order, - for null.
        written = [
            F.coalesce(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") if f.dataType.typeName() == "timestamp"
                       else F.col(f.name).cast("string"), F.lit("-"))
            for f in rows.schema
        ]
        part = rows.select(F.lit(name).alias("table_name"), F.concat_ws("|", *written).alias("columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def write_pivot(spark, sf_dir):
    folder = shared_folder(spark, "pivot")
    tables.write_parquet(base.skill_pivot(P.postings(spark, sf_dir)), folder)
    return tables.read_parquet_table(spark, folder)


@query
def write_csv(spark, sf_dir):
    folder = shared_folder(spark, "jobs-csv")
    jobs = P.raw_jobs(spark, sf_dir).select("slug", "title", "skills", "types", "salary_min")
    tables.write_csv(jobs, folder)
    return tables.read_csv(
        spark, folder, "slug string, title string, skills string, types string, salary_min int"
    )


def _order_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("company_key"), F.col("o_orderkey").alias("source_key"),
        F.col("o_totalprice").alias("amount"), "o_orderdate", "o_orderstatus",
    )


def _stored_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_key"), F.lit(None).cast("bigint").alias("source_key"),
        F.col("c_acctbal").alias("amount"),
    )


@query
def insert_ignore(spark, sf_dir):
    stored = _stored_companies(spark, sf_dir).where(F.col("amount") >= 0)
    incoming = _order_companies(spark, sf_dir)
    return keyed.insert_ignore(
        stored, incoming, ["company_key"], [F.asc("o_orderdate"), F.asc("source_key")]
    ).select("company_key", "source_key", "amount")


@query
def upsert_update(spark, sf_dir):
    """A stored table; the update rewrites the buckets of its own keys."""
    folder = shared_folder(spark, "companies")
    keyed_table.create(_stored_companies(spark, sf_dir), folder, ["company_key"])
    keyed_table.update(
        _order_companies(spark, sf_dir), folder,
        lambda stored, batch: keyed.upsert_update(
            stored, batch, ["company_key"], [F.desc("o_orderdate"), F.desc("source_key")]
        ),
    )
    return keyed_table.read(spark, folder)


def _result_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = P.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("slug"), F.lit(0).cast("bigint").alias("seq"),
        (F.col("c_acctbal") >= 0).alias("success"),
    )
    new = P.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") != "P").alias("success"),
    )
    return stored, new


@query
def upsert_keep_last(spark, sf_dir):
    """A stored table of successes; the update rewrites the buckets of its own keys."""
    stored, new = _result_batches(spark, sf_dir)
    folder = shared_folder(spark, "results")
    keyed_table.create(stored.where("success"), folder, ["slug"])
    keyed_table.update(
        new, folder, lambda old, batch: keyed.upsert_keep_last(old, batch, ["slug"], [F.desc("seq")])
    )
    return keyed_table.read(spark, folder)


@query
def union_keep_last(spark, sf_dir):
    stored, new = _result_batches(spark, sf_dir)
    return keyed.union_keep_last(stored, new, ["slug"], [F.desc("seq")])


@query
def write_classification_back(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False).select("slug", "title", "ai", "seniority")
    classified = jobs.where("ai").select(
        "slug", text.extract_seniority(F.col("title")).alias("seniority")
    )
    return keyed.write_classification_back(jobs, classified, "slug", ["seniority"])


def _url_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = P.url_results(spark, sf_dir)
    valid = text.url_is_valid(F.col("final_url"))
    return pages.select(
        "slug", "final_url", text.url_type(F.col("final_url")).alias("type"),
        valid.alias("success"), (F.col("page_id") % 5 + 1).cast("int").alias("attempts"),
        F.when(valid, 200).alias("status_code"),
        F.when(~valid, F.concat(F.lit("Invalid final URL: "), "final_url")).alias("error"),
        F.lit(1).alias("worker"),
    )


@query
def write_url_results(spark, sf_dir):
    folder = shared_folder(spark, "urls")
    tables.write_parquet(tables.url_results(_url_results(spark, sf_dir)), folder)
    return tables.read_parquet_table(spark, folder)


# Projections and filters -----------------------------------------------------------


@query
def cleaned_ctas(spark, sf_dir):
    jobs = keyed.cleaned_jobs(P.raw_jobs(spark, sf_dir), P.raw_companies(spark, sf_dir))
    return joined_text(jobs, "skills", "types")


@query
def facet_filter(spark, sf_dir):
    return filters.filter_postings(P.postings(spark, sf_dir), FILTERS).select(
        "job_id", *base.DIMENSIONS
    )


@query
def facet_filter_pivot(spark, sf_dir):
    rows = base.skill_pivot(P.postings(spark, sf_dir))
    return filters.filter_skill_rows(rows, FILTERS)


@query
def filter_any_skill(spark, sf_dir):
    return filters.filter_any_skill(P.postings(spark, sf_dir), ["Python", "Tableau"]).select(
        "job_id"
    )


@query
def filter_salary_range(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False)
    return filters.filter_salary_range(jobs).select("slug", "salary")


@query
def select_sample_ordered(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False).withColumnRenamed("slug", "job_slug")
    return filters.sample_ordered(jobs)


@query
def drop_missing_fill_defaults(spark, sf_dir):
    return base.fill_missing(P.analysis_jobs(spark, sf_dir)).select("job_id", *base.DIMENSIONS)


@query
def keep_category(spark, sf_dir):
    trend = settled_trends(P.postings(spark, sf_dir))
    return trends.top_of_category(trend, "Declining & Risky").select(
        "skill", "recent_momentum_pct", "trend_category"
    )


@query
def filter_summary(spark, sf_dir):
    return filters.filter_summary(P.postings(spark, sf_dir), FILTERS)


# Joins -----------------------------------------------------------------------------


@query
def listings_with_company(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False).select("slug", "company_slug", "title")
    return keyed.listings_with_company(jobs, P.raw_companies(spark, sf_dir))


@query
def join_group_totals(spark, sf_dir):
    return groups.with_group_totals(P.postings(spark, sf_dir), "country")


@query
def orphaned_jobs(spark, sf_dir):
    known = P.table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    jobs = P.table(spark, sf_dir, "orders")
    return keyed.orphan_count(jobs, known, "o_custkey", "c_custkey", "orphaned_jobs")


def _line_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, skill, category) once per line and word, repeats and all."""
    words = F.split("p_name", " ")
    parts = P.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.array(
            F.struct(words[0].alias("skill"), F.lit("technical").alias("category")),
            F.struct(words[1].alias("skill"), F.lit("tool").alias("category")),
            F.struct(F.lower("p_type").alias("skill"), F.lit("technical").alias("category")),
        ).alias("named"),
    )
    lines = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("job_id"), F.inline("named")
    )


@query
def orphaned_skills(spark, sf_dir):
    known = P.orders_in_full(spark, sf_dir, skills=False).where("c_acctbal >= 0")
    rows = _line_skills(spark, sf_dir)
    return keyed.orphan_count(rows, known, "job_id", "o_orderkey", "orphaned_skill_records")


@query
def semi_valid_jobs(spark, sf_dir):
    rows = base.distinct_skill_rows(_line_skills(spark, sf_dir))
    return base.jobs_with_enough_skills(rows, 10)


@query
def anti_processed(spark, sf_dir):
    wanted = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"))
    done = P.table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").alias("slug")
    )
    return keyed.unprocessed_keys(wanted, done, "slug")


@query
def skill_pair_selfjoin(spark, sf_dir):
    return pairs.pair_counts(P.postings(spark, sf_dir))


@query
def category_lookup(spark, sf_dir):
    rows = base.expand_skills(P.postings(spark, sf_dir))
    return rows.groupBy("skill").agg(F.count(F.lit(1)).alias("mentions")).withColumn(
        "skill_category", skill_fns.skill_category(F.col("skill"))
    )


@query
def currency_lookup(spark, sf_dir):
    jobs = with_usd_rate(P.raw_jobs(spark, sf_dir, skills=False))
    return jobs.groupBy("salary_currency", "usd_rate").agg(F.count(F.lit(1)).alias("jobs"))


# Aggregations ----------------------------------------------------------------------


@query
def skill_pivot(spark, sf_dir):
    return base.skill_pivot(P.postings(spark, sf_dir))


@query
def skill_pivot_job_ids(spark, sf_dir):
    return base.pivot_job_ids(P.postings(spark, sf_dir))


def _stored_rows(spark: SparkSession, sf_dir: str, wanted: dict) -> DataFrame:
    """Postings as a saved pivot gives them back, after filters on its rows."""
    folder = shared_folder(spark, "pivot-rows")
    tables.write_parquet(base.pivot_job_ids(P.postings(spark, sf_dir)), folder)
    rows = tables.read_parquet_table(spark, folder, "job_id", *base.DIMENSIONS, "skill")
    return base.postings_of_rows(filters.filter_skill_rows(rows, wanted))


@query
def filtered_pivot_frequency(spark, sf_dir):
    return base.skill_frequency(_stored_rows(spark, sf_dir, FILTERS))


@query
def filtered_pivot_roles(spark, sf_dir):
    wanted = {"date_range": ("1993-02-15", "1998-01-31"), "skills": ["Python", "SQL", "AWS", "Excel"]}
    return groups.skills_by_role(_stored_rows(spark, sf_dir, wanted), 3)


@query
def aggregate_pivot(spark, sf_dir):
    return base.aggregate_by(P.postings(spark, sf_dir), "company_name")


@query
def skill_frequency(spark, sf_dir):
    return base.skill_frequency(P.postings(spark, sf_dir))


@query
def skill_category_frequency(spark, sf_dir):
    return base.skill_category_frequency(P.postings(spark, sf_dir))


@query
def monthly_totals(spark, sf_dir):
    return trends.monthly_totals(P.postings(spark, sf_dir))


@query
def skill_month_matrix(spark, sf_dir):
    return trends.skill_month_matrix(P.postings(spark, sf_dir))


@query
def trend_summary(spark, sf_dir):
    return trends.trend_summary(settled_trends(P.postings(spark, sf_dir)))


@query
def category_means(spark, sf_dir):
    return trends.category_means(settled_trends(P.postings(spark, sf_dir)))


@query
def trend_distribution(spark, sf_dir):
    return trends.trend_distribution(settled_trends(P.postings(spark, sf_dir)))


@query
def facet_values(spark, sf_dir):
    chosen = {"date_range": FILTERS["date_range"], "job_type": "contract"}
    return filters.facet_values(P.postings(spark, sf_dir), chosen)


@query
def overview_metrics(spark, sf_dir):
    jobs = annual_usd_salaries(P.raw_jobs(spark, sf_dir))
    named = jobs.select(
        F.col("company_slug").alias("company_name"), "salary_annual_usd",
        skill_fns.skills_count(F.col("skills")).alias("skills_count"),
    )
    return filters.overview_metrics(named)


@query
def dataset_profile(spark, sf_dir):
    return quality.dataset_profile(P.postings(spark, sf_dir))


@query
def company_job_counts(spark, sf_dir):
    return quality.company_job_counts(P.raw_jobs(spark, sf_dir, skills=False))


@query
def table_counts(spark, sf_dir):
    names = {"jobs": "orders", "companies": "customer", "locations": "nation"}
    return quality.table_counts({k: P.table(spark, sf_dir, v) for k, v in names.items()})


@query
def cleaning_progress(spark, sf_dir):
    columns = ("standardized_title", "seniority_level", "job_type", "work_mode", "country",
               "salary_max")
    return quality.cleaning_progress(P.analysis_jobs(spark, sf_dir), columns)


@query
def distinct_currencies(spark, sf_dir):
    return quality.distinct_currencies(P.raw_jobs(spark, sf_dir, skills=False), "salary_currency")


@query
def metric_correlation(spark, sf_dir):
    return trends.metric_correlation(settled_trends(P.postings(spark, sf_dir)))


@query
def normalized_category_profile(spark, sf_dir):
    return trends.normalized_category_profile(settled_trends(P.postings(spark, sf_dir)))


@query
def category_box_stats(spark, sf_dir):
    return trends.category_box_stats(settled_trends(P.postings(spark, sf_dir)))


@query
def url_success_rate(spark, sf_dir):
    return quality.url_success_rate(_url_results(spark, sf_dir))


# Windows, sorts, sets --------------------------------------------------------------


@query
def dedupe_earliest(spark, sf_dir):
    """Lines as postings that repeat: five columns decide, the earliest shipped stays."""
    lines = P.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("job_slug"),
        F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("country"),
        F.array("l_returnflag", "l_linestatus").alias("skills"),
        F.col("l_linenumber").alias("salary_min"), F.col("l_quantity").cast("int").alias("salary_max"),
        F.when(F.col("l_discount") < 0.09, F.col("l_shipdate")).alias("published"),
    )
    return joined_text(keyed.dedupe_earliest(lines), "skills")


@query
def share_in_group(spark, sf_dir):
    rows = base.expand_skills(P.postings(spark, sf_dir), "published", "country")
    cells = rows.groupBy("published", "country", "skill").agg(F.count(F.lit(1)).alias("mentions"))
    return base.share_in_group(cells, ["published", "country"])


@query
def topn_per_group(spark, sf_dir):
    return groups.skills_by_group(P.postings(spark, sf_dir), "published", 5)


def _rolling(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    series = settled_series(P.postings(spark, sf_dir))
    return trends.rolling_metrics(series).select("skill", *columns)


@query
def recent_percentile(spark, sf_dir):
    return _rolling(spark, sf_dir, "recent_percentile")


@query
def recent_vs_previous(spark, sf_dir):
    return _rolling(spark, sf_dir, "recent_avg", "previous_avg", "recent_momentum_pct")


@query
def mom_growth(spark, sf_dir):
    return trends.mom_growth(settled_series(P.postings(spark, sf_dir)))


@query
def cumulative_share(spark, sf_dir):
    return seniority.cumulative_share(P.postings(spark, sf_dir))


def _progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.skill_progression(P.postings(spark, sf_dir), KEY_SKILLS)


@query
def peak_level(spark, sf_dir):
    return groups.peak_level(_progression(spark, sf_dir))


@query
def order_by_metric(spark, sf_dir):
    ranked = base.aggregate_by(P.postings(spark, sf_dir), "country")
    return base.order_by_metric(ranked, "prevalence", "country")


@query
def topk(spark, sf_dir):
    ranked = base.aggregate_by(P.postings(spark, sf_dir), "company_name")
    return base.order_by_metric(ranked, "mentions", "company_name").limit(10)


@query
def top_emerging_declining(spark, sf_dir):
    return trends.top_emerging_declining(settled_trends(P.postings(spark, sf_dir)))


@query
def order_by_level(spark, sf_dir):
    return groups.order_by_level(_progression(spark, sf_dir))


@query
def top_rows_by_mean(spark, sf_dir):
    return groups.top_rows_by_mean(groups.role_profile(P.postings(spark, sf_dir)))


@query
def top_by_avg_prevalence(spark, sf_dir):
    return groups.top_by_avg_prevalence(_progression(spark, sf_dir), 3)


@query
def distinct_rows(spark, sf_dir):
    return base.distinct_skill_rows(_line_skills(spark, sf_dir))


@query
def distinct_skill_details(spark, sf_dir):
    rows = _line_skills(spark, sf_dir).select(
        F.col("job_id").alias("job_slug"), F.col("skill").alias("skill_name"),
        F.col("category").alias("skill_category"),
    )
    return payloads.distinct_skill_details(rows)


@query
def union_of_pair_skills(spark, sf_dir):
    return pairs.union_of_pair_skills(pairs.skill_pairs(P.postings(spark, sf_dir)))


@query
def job_set_overlap(spark, sf_dir):
    rows = P.postings(spark, sf_dir)
    return pairs.job_set_overlap(rows, pairs.skill_pairs(rows, top_n=40), "mentions")


# Scalar functions ------------------------------------------------------------------


@query
def standardize_country(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False)
    return cleaning.clean_country(jobs.select("slug", "country"))


@query
def remove_generic_skills(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir).select("slug", "skills")
    kept = jobs.withColumn("skills", skill_fns.remove_generic_skills(F.col("skills")))
    return joined_text(kept, "skills")


@query
def month_key(spark, sf_dir):
    orders = P.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", dates.month_key(F.col("o_orderdate")).alias("published"))


@query
def salary_annual_usd(spark, sf_dir):
    jobs = annual_usd_salaries(P.raw_jobs(spark, sf_dir, skills=False))
    return jobs.select(
        "slug", "salary_min_annual_usd", "salary_max_annual_usd", "salary_annual_usd"
    )


@query
def job_type_mode(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False).select("slug", "types")
    return cleaning.clean_employment(jobs).drop("types")


@query
def extract_seniority(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False)
    return jobs.select(
        "slug", "title", text.extract_seniority(F.col("title")).alias("seniority_level")
    )


def _skill_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills as list text, comma text, broken list text or blank, by priority."""
    orders = P.orders_in_full(spark, sf_dir)
    quoted = F.concat(F.lit("['"), F.array_join("skills", "', '"), F.lit("']"))
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", quoted)
        .when(F.col("o_orderpriority") == "2-HIGH", F.array_join("skills", " ,, "))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.to_json("skills"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
              F.concat(F.lit("['"), F.array_join("skills", ", ")))
        .otherwise(F.lit("  "))
    )
    return orders.select("o_orderkey", spelled.alias("written"))


@query
def parse_skill_list(spark, sf_dir):
    rows = _skill_texts(spark, sf_dir)
    parsed = rows.withColumn("skills", skill_fns.parse_skill_list(F.col("written")))
    return joined_text(parsed, "skills").drop("written")


@query
def split_csv_skills(spark, sf_dir):
    rows = _skill_texts(spark, sf_dir)
    parsed = rows.withColumn("skills", skill_fns.split_csv(F.col("written")))
    return parsed.select("o_orderkey", F.size("skills").alias("n"),
                         F.array_join("skills", "|").alias("skills"))


@query
def normalize_skill_array(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir)
    normal = jobs.select("slug", skill_fns.normalize_skills(F.col("skills")).alias("skills"))
    return normal.where(F.size("skills") > 0).select("slug", F.explode("skills").alias("skill"))


@query
def unpivot_skill_arrays(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir)
    skills = F.col("skills")
    lists = {
        "skills": skills, "soft_skills": F.filter(skills, lambda x: x == "Communication"),
        "tools": F.filter(skills, lambda x: x.isin("Excel", "Tableau")),
        "languages": F.filter(skills, lambda x: x.isin("Python", "R", "SQL")),
        "frameworks": F.filter(skills, lambda x: x.isin("TensorFlow", "PyTorch")),
        "libraries": F.array().cast("array<string>"),
    }
    return payloads.unpivot_skill_arrays(jobs.withColumns(lists))


@query
def null_sentinel_dates(spark, sf_dir):
    orders = P.table(spark, sf_dir, "orders")
    spelled = (
        F.when(F.col("o_orderstatus") == "P", F.lit("0001-01-01T00:00:00Z"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("soon"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return orders.select("o_orderkey", dates.parse_moment(spelled).alias("published"))


@query
def compose_location(spark, sf_dir):
    jobs = P.orders_in_full(spark, sf_dir, skills=False)
    place = F.when(F.col("n_nationkey") % 5 == 0, F.lit("Somewhere"))
    city = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    country = F.coalesce(P.listed(P.RAW_COUNTRIES), F.lit(""))
    return jobs.select("o_orderkey", text.compose_location(place, city, country).alias("location"))


@query
def employment_types(spark, sf_dir):
    jobs = P.orders_in_full(spark, sf_dir, skills=False)
    kind = F.when(F.col("o_orderstatus") == "F", P.type_text()).otherwise(F.lit(""))
    given = F.when(F.col("o_orderpriority") != "5-LOW", F.array("o_orderpriority"))
    return jobs.select(
        "o_orderkey",
        F.array_join(payloads.employment_types(kind, given), "|").alias("types"),
    )


@query
def month_range_filter(spark, sf_dir):
    rows = P.postings(spark, sf_dir).where(
        dates.month_between(F.col("published"), "1996-03-01", "1998-02-01")
    )
    return rows.select("job_id", "published")


@query
def url_is_valid(spark, sf_dir):
    pages = P.url_results(spark, sf_dir)
    return pages.select("slug", text.url_is_valid(F.col("final_url")).alias("valid"))


@query
def url_type(spark, sf_dir):
    pages = P.url_results(spark, sf_dir)
    return pages.select("slug", text.url_type(F.col("final_url")).alias("type"))


@query
def skills_count(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir)
    return jobs.select("slug", skill_fns.skills_count(F.col("skills")).alias("skills_count"))


@query
def pair_domain_label(spark, sf_dir):
    counted = pairs.pair_counts(P.postings(spark, sf_dir))
    label = skill_fns.pair_domain_label(F.col("skill_1"), F.col("skill_2"))
    return counted.select("skill_1", "skill_2", label.alias("combination_type"))


@query
def dates_to_parts(spark, sf_dir):
    orders = P.table(spark, sf_dir, "orders")
    spelled = (
        F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-13-dd"))
        .when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    year, month = dates.year_month_of(spelled)
    return orders.select("o_orderkey", year.alias("published_year"), month.alias("published_month"))


@query
def log_volume_score(spark, sf_dir):
    return settled_trends(P.postings(spark, sf_dir)).select(
        "skill", "trend_confidence", "volume_adjusted_score"
    )


@query
def exchange_rate_rows(spark, sf_dir):
    customers = P.table(spark, sf_dir, "customer")
    doc = F.to_json(
        F.struct(
            (F.abs("c_acctbal") / 100 + 1).alias("EUR"),
            (F.col("c_nationkey") + 2).alias("JPY"), F.lit(7.5).alias("USD"),
        )
    )
    raw = customers.select("c_custkey", doc.alias("rates"))
    return payloads.exchange_rate_rows(raw, "c_custkey", "rates")


# Trends ----------------------------------------------------------------------------


@query
def ewma(spark, sf_dir):
    return trends.smoothed(settled_series(P.postings(spark, sf_dir)), "prevalence")


@query
def growth_rates(spark, sf_dir):
    return trends.growth_rates(settled_series(P.postings(spark, sf_dir)))


@query
def cagr(spark, sf_dir):
    return _rolling(spark, sf_dir, "cagr_pct")


@query
def momentum_peak(spark, sf_dir):
    return _rolling(spark, sf_dir, "recent_momentum_pct", "current_value", "peak_ratio")


@query
def ols_trend(spark, sf_dir):
    series = settled_series(P.postings(spark, sf_dir))
    return trends.ols_trend(series).select("skill", "trend_slope", "trend_intercept")


@query
def nonlinearity(spark, sf_dir):
    series = settled_series(P.postings(spark, sf_dir))
    return trends.ols_trend(series).select("skill", "nonlinearity")


@query
def hybrid_momentum(spark, sf_dir):
    metrics = trends.trend_metrics(settled_series(P.postings(spark, sf_dir)))
    return metrics.select("skill", "baseline_mentions", "growth_reliability", "recent_momentum_pct")


@query
def momentum_quantiles(spark, sf_dir):
    return trends.momentum_quantiles(
        trends.trend_metrics(settled_series(P.postings(spark, sf_dir)))
    )


@query
def index_quantiles(spark, sf_dir):
    return trends.index_quantiles(
        trends.trend_metrics(settled_series(P.postings(spark, sf_dir)))
    )


@query
def trend_category(spark, sf_dir):
    return settled_trends(P.postings(spark, sf_dir)).select("skill", "trend_category")


@query
def skill_trends(spark, sf_dir):
    trend = trends.skill_trends(settled_series(P.postings(spark, sf_dir)))
    return trends.ranked_trends(trend)


@query
def process_trends(spark, sf_dir):
    return trends.process_trends(settled_series(P.postings(spark, sf_dir)))


@query
def skill_timeline(spark, sf_dir):
    return trends.skill_timeline(P.postings(spark, sf_dir), ["Python", "AWS", "NLP"])


@query
def trend_flags(spark, sf_dir):
    return settled_trends(P.postings(spark, sf_dir)).select(
        "skill", "is_emerging", "is_declining", "is_growing", "is_stable", "is_special"
    )


@query
def trend_insights(spark, sf_dir):
    return trends.trend_insights(settled_trends(P.postings(spark, sf_dir)))


# Pairs, groups, seniority ----------------------------------------------------------


@query
def skill_pairs(spark, sf_dir):
    return pairs.skill_pairs(stored_postings(spark, sf_dir, "job_id", "skills"))


@query
def pair_synergy(spark, sf_dir):
    rows = stored_postings(spark, sf_dir, "job_id", "skills")
    return pairs.pair_synergy(rows, pairs.skill_pairs(rows, top_n=200), "mentions").select(
        "skill_1", "skill_2", "learning_synergy"
    )


@query
def pair_prevalence(spark, sf_dir):
    return pairs.pair_prevalence(stored_postings(spark, sf_dir, "job_id", "skills"))


@query
def skill_clusters(spark, sf_dir):
    return joined_text(pairs.skill_clusters(stored_postings(spark, sf_dir, "job_id", "skills")), "skills")


@query
def universal_specialized(spark, sf_dir):
    return ecosystem.universal_specialized(P.postings(spark, sf_dir))


@query
def skill_ecosystem(spark, sf_dir):
    return ecosystem.ecosystem_rows(stored_postings(spark, sf_dir, "job_id", "standardized_title", "skills"))


@query
def role_specializations(spark, sf_dir):
    return ecosystem.role_specializations(P.postings(spark, sf_dir))


@query
def skills_by_group(spark, sf_dir):
    return groups.skills_by_group(P.postings(spark, sf_dir), "job_type", 15)


@query
def skills_by_role(spark, sf_dir):
    return groups.skills_by_role(P.postings(spark, sf_dir))


@query
def skills_by_seniority(spark, sf_dir):
    return groups.skills_by_seniority(P.postings(spark, sf_dir))


@query
def skills_by_country(spark, sf_dir):
    return groups.skills_by_country(P.postings(spark, sf_dir))


@query
def role_comparison(spark, sf_dir):
    return groups.role_comparison(P.postings(spark, sf_dir), P.ROLES)


@query
def skill_progression(spark, sf_dir):
    return _progression(spark, sf_dir)


@query
def progression_heatmap(spark, sf_dir):
    return groups.progression_heatmap(_progression(spark, sf_dir))


@query
def seniority_patterns(spark, sf_dir):
    return seniority.seniority_patterns(P.postings(spark, sf_dir))


@query
def level_specific_skills(spark, sf_dir):
    rows = stored_postings(spark, sf_dir, *base.DIMENSIONS, "skills")
    progression = groups.skill_progression(rows, KEY_SKILLS)
    return seniority.level_specific_skills(rows, progression, threshold=1.02)


@query
def skill_diversity(spark, sf_dir):
    return seniority.skill_diversity(P.postings(spark, sf_dir))


@query
def normalized_level_comparison(spark, sf_dir):
    return seniority.normalized_level_comparison(P.postings(spark, sf_dir))


# Classification and salaries -------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = P.title_vectors(spark, sf_dir)
    return vectors, titles.category_centroids(vectors, "label", "embedding")


@query
def nearest_category(spark, sf_dir):
    vectors, centroids = _vectors(spark, sf_dir)
    return titles.nearest_category(
        vectors, "embedding", titles.category_model(centroids), 0.47
    ).select(
        "vec_id", "standardized_title", "similarity_score"
    )


@query
def category_centroids(spark, sf_dir):
    _, centroids = _vectors(spark, sf_dir)
    return centroids.select("category", F.posexplode("centroid").alias("position", "x"))


@query
def similarity_matrix(spark, sf_dir):
    vectors, centroids = _vectors(spark, sf_dir)
    return titles.similarity_matrix(
        vectors, "vec_id", "embedding", titles.category_model(centroids)
    )


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_salary_range(P.postings(spark, sf_dir))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals; the postings behind the means and the rows are computed once."""
    paid = _paid(spark, sf_dir).select("job_id", "skills", "salary", *P.CONFOUNDERS, *P.CONTROLS)
    return salaries.salary_baseline(settle(paid, "paid"), P.CONFOUNDERS)


@query
def salary_baseline_residual(spark, sf_dir):
    return _residuals(spark, sf_dir).select("job_id", "salary", "baseline", "residual")


@query
def salary_baseline_fit(spark, sf_dir):
    return salaries.baseline_fit(_residuals(spark, sf_dir))


@query
def salary_boosted_baseline(spark, sf_dir):
    fitted = salaries.boosted_baseline(_paid(spark, sf_dir).select("job_id", "salary", *P.CONFOUNDERS), P.CONFOUNDERS)
    return salaries.baseline_fit(fitted)


@query
def job_skill_rows(spark, sf_dir):
    return salaries.job_skill_rows(P.postings(spark, sf_dir), 5, P.CONTROLS)


@query
def job_skill_matrix(spark, sf_dir):
    listed = sorted({v.strip().lower() for v in P.SKILL_OF_TOKEN.values()})
    return salaries.job_skill_matrix(P.postings(spark, sf_dir), listed, P.CONTROLS)


@query
def skill_dictionary(spark, sf_dir):
    return salaries.skill_dictionary(P.postings(spark, sf_dir))


@query
def job_skill_vectors(spark, sf_dir):
    rows = P.postings(spark, sf_dir)
    vectors = salaries.job_skill_vectors(rows, salaries.skill_dictionary(rows), P.CONTROLS)
    return vectors.withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query
def skill_residual_model(spark, sf_dir):
    fitted = settle(_residuals(spark, sf_dir).select("job_id", "skills", "residual", *P.CONTROLS), "residuals")
    return salaries.residual_fit(salaries.skill_residual_model(fitted, P.CONTROLS))


@query
def skill_effects(spark, sf_dir):
    effects = salaries.skill_effects(_residuals(spark, sf_dir), P.CONTROLS)
    return effects.withColumn("coefficient", F.round("coefficient", 3))


@query
def skill_premium(spark, sf_dir):
    return salaries.skill_premium(_residuals(spark, sf_dir))


@query
def skill_interactions(spark, sf_dir):
    return salaries.skill_interactions(_residuals(spark, sf_dir))


@query
def salary_two_stage(spark, sf_dir):
    parts = salaries.salary_two_stage(_paid(spark, sf_dir), P.CONFOUNDERS, P.CONTROLS)
    none = F.lit(None).cast("string")
    fit = parts.baseline_r2().select(
        F.lit("baseline_r2").alias("part"), none.alias("skill"), none.alias("other"),
        F.col("r2").alias("value"),
    )
    premiums = parts.skill_premiums().select(
        F.lit("skill_premiums").alias("part"), "skill", none.alias("other"),
        F.col("dollar_premium").alias("value"),
    )
    joint = parts.skill_interactions().select(
        F.lit("skill_interactions").alias("part"), F.col("skill_1").alias("skill"),
        F.col("skill_2").alias("other"), F.col("synergy").alias("value"),
    )
    explained = parts.skill_r2().select(
        F.lit("skill_r2").alias("part"), none.alias("skill"), none.alias("other"),
        F.col("r2").alias("value"),
    )
    return fit.unionByName(explained).unionByName(premiums).unionByName(joint)


# Quality ---------------------------------------------------------------------------


@query
def quality_report(spark, sf_dir):
    jobs = P.raw_jobs(spark, sf_dir, skills=False)
    return quality.quality_report(jobs, F.lit("2001-01-01").cast("timestamp"))


@query
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(
        P.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query
def missing_profile(spark, sf_dir):
    return quality.missing_profile(P.analysis_jobs(spark, sf_dir))


# Cleaning as a whole ---------------------------------------------------------------


@query
def clean_jobs(spark, sf_dir):
    jobs = cleaning.clean_jobs(P.raw_jobs(spark, sf_dir), P.raw_companies(spark, sf_dir))
    return joined_text(jobs.drop("seniority"), "skills", "types")


# Streams ---------------------------------------------------------------------------


def _changes(events: DataFrame) -> DataFrame:
    """Events as job changes of a company."""
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), F.lit("insert")).when(
        kind == "error", F.lit("delete")
    ).otherwise(F.lit("update"))
    return events.select(
        F.col("user_id").alias("company_slug"), op.alias("op"),
        F.when(kind == "error", F.lit(True)).when(kind == "view", F.lit(False)).when(
            kind == "click", F.lit(True)).alias("old_ai"),
        F.when(kind == "signup", F.lit(False)).when(kind == "purchase", F.lit(True)).when(
            kind == "view", F.lit(True)).when(kind == "click", F.lit(False)).alias("new_ai"),
    )


def _event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = P.table(spark, sf_dir, "events").schema
    return feeds.read_feed(spark, sf_dir, schema, "events.parquet")


@query
def stream_company_counts(spark, sf_dir):
    folder = shared_folder(spark, "company-counts")
    counts = feeds.company_counts(_changes(_event_feed(spark, sf_dir)))
    feeds.write_changes(counts, folder, f"{folder}-state").awaitTermination()
    return feeds.latest_counts(spark, folder)


@query
def stream_dedupe(spark, sf_dir):
    folder = shared_folder(spark, "first-seen")
    feed = _event_feed(spark, sf_dir).select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    first = feeds.first_seen(feed, ["user_id", "event_type"])
    feeds.append_rows(first, folder, f"{folder}-state").awaitTermination()
    return spark.read.parquet(folder).select("user_id", "event_type")


@query
def stream_session_first(spark, sf_dir):
    """Three deliveries of events by time; of a key's rows within a day of each other the first."""
    source, folder = shared_folder(spark, "event-files"), shared_folder(spark, "session-first")
    events = P.table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")
    )
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.expr(f"least(2, 3 * (unix_micros(ts) - {low}) div greatest(1, {high} - {low}))")
    with feeds.state_on_disk(spark):
        for part in range(3):
            events.where(third == part).write.mode("append").parquet(source)
            feed = feeds.read_feed(spark, source, events.schema)
            first = feeds.first_of_session(
                feed, ["user_id", "event_type"], "ts", "event_id", "1 day", "1 hour"
            )
            feeds.append_rows(first, folder, f"{folder}-state").awaitTermination()
    return spark.read.parquet(folder).select("user_id", "event_type", "event_id")


@query
def stream_batch_upsert(spark, sf_dir):
    """Three deliveries of events, each caught up before the next; a key's first row wins."""
    source, folder = shared_folder(spark, "event-files"), shared_folder(spark, "event-table")
    events = P.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    keys = ["user_id", "event_type"]
    feeds.write_table(events.limit(0), folder, keys)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.expr(f"least(2, 3 * (event_id - {low}) div greatest(1, {high} - {low}))")
    for part in range(3):
        events.where(third == part).write.mode("append").parquet(source)
        feed = feeds.read_feed(spark, source, events.schema)
        feeds.insert_batches(
            feed, folder, f"{folder}-state", keys, lambda: [F.asc("event_id")]
        ).awaitTermination()
    return spark.read.parquet(folder).select(*keys, "event_id")


@query
def stamp_updated_at(spark, sf_dir):
    made = F.lit("2020-01-01").cast("timestamp")
    stored = _stored_companies(spark, sf_dir).where(F.col("amount") >= 0).withColumns(
        {"created_at_utc": made, "updated_at_utc": made}
    )
    return keyed.upsert_stamped(
        stored, _order_companies(spark, sf_dir), ["company_key"],
        [F.desc("o_orderdate"), F.desc("source_key")], F.lit("2024-05-01").cast("timestamp"),
    )
