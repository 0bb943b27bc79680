"""The given tables seen as job postings.

An order is a posting, its customer the company, the words of the parts on its
lines the skills. Names and codes are replaced through small literal lists so that
every text rule, currency and category of the engine is met by real rows; nothing
is filtered, sampled or invented beyond the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.dates import month_key
from talentgrid.functions.vectors import as_doubles
from talentgrid.operators.postings import prepare_postings

# Part word or type -> skill as an advertiser would write it.
SKILL_OF_TOKEN = {
    "blue": "Python", "cold": "SQL", "hot": "R", "large": "Java", "new": "Machine Learning",
    "old": "TensorFlow", "red": "PyTorch", "small": "Spark", "anvil": "Hadoop", "bolt": "AWS",
    "gear": "Docker", "gizmo": "Tableau", "plate": "Statistics", "ring": "Communication",
    "rod": "Excel", "widget": "Airflow", "PROMO": "NLP", "MEDIUM": "AI", "LARGE": "java ",
    "STANDARD": "Deep Learning", "SMALL": "SPARK", "ECONOMY": "Kubernetes",
}

# By n_nationkey: the country as an advertiser would write it.
RAW_COUNTRIES = [
    "USA", "CA", "uk", "france", "Rio de Janeiro", "Belgium; France", "US: Remote",
    "guinea-bissau", "[ ]", " ", None, "Deutschland", "Germany", "IN", "Republic of Korea",
    "south africa", "Czechia", "The Netherlands", "UAE", "North America", "Lisboa: Centro",
    "Unknown", "Bosnia", "Saint Lucia; Castries", "new zealand",
]

# By n_nationkey: pay currency.
CURRENCIES = [
    "USD", "EUR", "GBP", "CAD", "AUD", "JPY", "CNY", "INR", "PLN", "SEK", "DKK", "CHF", "BRL",
    "MXN", "KRW", "VND", "AED", "SGD", "ZAR", "NZD", "KWD", "XXX", None, "VES", "TRY",
]

ROLE_OF_SEGMENT = {
    "BUILDING": "Data Engineer", "AUTOMOBILE": "Data Scientist",
    "MACHINERY": "Machine Learning Engineer", "HOUSEHOLD": "Data Analyst",
    "FURNITURE": "AI Engineer",
}
MODE_TEXT_OF_SEGMENT = {
    "BUILDING": "On-site", "AUTOMOBILE": "Remote", "MACHINERY": "Hybrid", "FURNITURE": "remoto",
}
MODE_OF_SEGMENT = {
    "BUILDING": "onsite", "AUTOMOBILE": "remote", "MACHINERY": "hybrid", "FURNITURE": "remote",
}
TITLE_PREFIX = {
    "1-URGENT": "Senior", "2-HIGH": "Staff", "3-MEDIUM": "Jr.", "5-LOW": "Trainee",
}
TITLE_SUFFIX = {"F": "Director", "O": "Analyst", "P": "VP"}
PERIOD_OF_PRIORITY = {
    "1-URGENT": "Hourly", "2-HIGH": "/month", "3-MEDIUM": "WEEK", "4-NOT SPECIFIED": "yearly",
}
TYPE_TEXT_OF_STATUS = {
    "F": "Full-time", "O": "Part time or working student", "P": "Contract",
}
TYPE_OF_STATUS = {"F": "full_time", "O": "part_time", "P": "contract"}
LEVEL_OF_PRIORITY = {
    "1-URGENT": "Senior", "2-HIGH": "Lead", "3-MEDIUM": "Junior", "5-LOW": "Intern",
}
LEVEL_OF_STATUS = {"F": "Manager", "O": "Unspecified", "P": "Executive"}
ROLES = sorted(ROLE_OF_SEGMENT.values())

# Confounders and controls of the salary queries.
CONFOUNDERS = ["company_name", "published", "country"]
CONTROLS = ["work_mode", "job_type"]


# Declared, so that no job has to read file footers first.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "\\'") + "'"


def mapped(column: str, values: dict[str, str]) -> Column:
    whens = " ".join(f"WHEN {_literal(k)} THEN {_literal(v)}" for k, v in values.items())
    return F.expr(f"CASE {column} {whens} END")


def listed(values: list[str | None]) -> Column:
    return F.expr(f"array({', '.join(_literal(v) for v in values)})[n_nationkey]")


def order_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, distinct skills as written, sorted): every word of its parts' names and
    their types; a word without an entry in the list stands for itself."""
    written = F.create_map(*[F.lit(x) for pair in SKILL_OF_TOKEN.items() for x in pair])
    words = F.array_compact(F.concat(F.split("p_name", " "), F.array("p_type")))
    skills = F.transform(words, lambda w: F.coalesce(written[w], w))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.array_distinct(skills).alias("named")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # One row a line, not one a word; an order has few lines.
    each = lines.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.collect_list("named").alias("lists"))
    distinct = F.array_sort(F.array_distinct(F.flatten("lists")))
    return each.select("l_orderkey", distinct.alias("skills"))


def orders_in_full(spark: SparkSession, sf_dir: str, skills: bool = True) -> DataFrame:
    """Orders with customer and nation columns, and the skills of their lines."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = table(spark, sf_dir, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    if not skills:
        return orders
    named = order_skills(spark, sf_dir)
    return orders.join(named, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def _salary_columns() -> dict[str, Column]:
    price = F.col("o_totalprice")
    low = F.when(F.col("o_orderpriority") != "5-LOW", F.floor(price / 10).cast("int"))
    high = F.when(
        F.col("o_orderpriority") != "4-NOT SPECIFIED",
        F.when(F.col("o_orderstatus") == "P", F.floor(price / 20)).otherwise(
            F.floor(price / 5)
        ).cast("int"),
    )
    return {"salary_min": low, "salary_max": high}


def type_text() -> Column:
    kind = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Internship")).otherwise(
        mapped("o_orderstatus", TYPE_TEXT_OF_STATUS)
    )
    return F.concat_ws(", ", kind, mapped("c_mktsegment", MODE_TEXT_OF_SEGMENT))


def raw_title() -> Column:
    written = F.concat_ws(
        " ", mapped("o_orderpriority", TITLE_PREFIX), mapped("c_mktsegment", ROLE_OF_SEGMENT),
        mapped("o_orderstatus", TITLE_SUFFIX),
    )
    return F.when(F.col("n_nationkey") == 24, F.lit(" ")).otherwise(written)


def raw_jobs(spark: SparkSession, sf_dir: str, skills: bool = True) -> DataFrame:
    """The raw jobs table."""
    orders = orders_in_full(spark, sf_dir, skills)
    return orders.select(
        F.col("o_orderkey").cast("string").alias("slug"),
        F.col("o_custkey").cast("string").alias("company_slug"),
        raw_title().alias("title"),
        (F.col("c_acctbal") >= 0).alias("ai"),
        F.col("o_orderdate").cast("timestamp").alias("published"),
        *([F.col("skills")] if skills else []),
        F.array(type_text(), F.lit("Internship")).alias("types"),
        mapped("o_orderpriority", LEVEL_OF_PRIORITY).alias("seniority"),
        F.col("n_name").alias("city"),
        listed(RAW_COUNTRIES).alias("country"),
        *[c.alias(name) for name, c in _salary_columns().items()],
        listed(CURRENCIES).alias("salary_currency"),
        mapped("o_orderpriority", PERIOD_OF_PRIORITY).alias("salary_period"),
    )


def raw_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw companies table."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("slug"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("logo/"), F.col("c_custkey").cast("string")).alias("logo"),
        F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("url"),
        F.concat(F.col("c_name"), F.lit(" in "), F.col("c_mktsegment")).alias("description"),
        (F.col("c_nationkey") * 10).alias("linkedin_staff_count"),
        (F.lit(1990) + F.col("c_nationkey")).alias("year_founded"),
        F.col("c_mktsegment").alias("company_sector"),
        F.floor("c_acctbal").cast("int").alias("linkedin_follower_count"),
    )


def analysis_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned jobs as the analysis gets them: some dimensions missing or blank."""
    orders = orders_in_full(spark, sf_dir)
    level = F.coalesce(
        mapped("o_orderpriority", LEVEL_OF_PRIORITY), mapped("o_orderstatus", LEVEL_OF_STATUS)
    )
    country = F.when(F.col("n_nationkey") == 8, F.lit(" ")).when(
        F.col("n_nationkey") != 7, F.col("n_name")
    )
    return orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        month_key(F.col("o_orderdate")).alias("published"),
        country.alias("country"),
        F.col("c_name").alias("company_name"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("internship")).otherwise(
            mapped("o_orderstatus", TYPE_OF_STATUS)
        ).alias("job_type"),
        mapped("c_mktsegment", MODE_OF_SEGMENT).alias("work_mode"),
        mapped("c_mktsegment", ROLE_OF_SEGMENT).alias("standardized_title"),
        level.alias("seniority_level"),
        "skills",
        *[c.alias(name) for name, c in _salary_columns().items()],
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis-ready postings of the given tables."""
    return prepare_postings(analysis_jobs(spark, sf_dir))


def url_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as URL results; hosts renamed so that several URL types occur, and URLs
    of plain http pages without their scheme."""
    url = F.col("url")
    for host, mark in (("example.com", "greenhouse.io"), ("example.net", "jobs.Lever.co")):
        url = F.replace(url, F.lit(host), F.lit(mark))
    bare = F.regexp_replace(url, "^http://", "")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("slug"), bare.alias("final_url"), "page_id"
    )


def title_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label"), as_doubles(F.col("embedding")).alias("embedding")
    )
