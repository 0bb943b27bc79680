"""The same answers in SQL, written independently, for checking on the given tables.

Named parts are joined into a WITH clause as a statement mentions them.
"""

from __future__ import annotations

import re

from talentgrid import fixed_values as fv
from talentgrid.operators import salaries
from talentgrid.plans import projection as P

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def values_table(pairs) -> str:
    return "(VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs) + ")"


def case(column: str, values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items())
    return f"CASE {column} {whens} END"


def first_match(text: str, rules, pattern=r"(?i)\b(?:{})\b") -> str:
    return " ".join(
        f"WHEN regexp_matches({text}, {quoted(pattern.format(words))}) THEN {quoted(name)}"
        for name, words in rules
    )


def with_parts(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in PARTS:
            if name not in (own, *needed) and re.search(rf"\b{name}\b", text):
                visit(PARTS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return ("WITH RECURSIVE " if {"cluster_walk", "solve_walk"} & set(needed) else "WITH ") + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" + sql


def check(name: str, sql: str, doubles: str | list[str] = "") -> None:
    """Register a statement; the named columns are rounded to six digits."""
    if doubles:
        names = doubles.split() if isinstance(doubles, str) else doubles
        rounds = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)
        sql = f"SELECT * REPLACE ({rounds}) FROM ({sql})"
    ORACLE[name] = with_parts(sql)


# The tables as postings ------------------------------------------------------------

PARTS["token_skill"] = f"SELECT * FROM {values_table(P.SKILL_OF_TOKEN.items())} t(token, skill)"
PARTS["skill_cat"] = "SELECT * FROM {} t(skill, category)".format(
    values_table((s, c) for c, skills in fv.SKILL_CATEGORIES.items() for s in skills)
)
PARTS["usd"] = "SELECT currency, CAST(rate AS DECIMAL(12,7)) AS rate FROM {} t(currency, rate)".format(
    values_table(fv.USD_PER_UNIT.items())
)
PARTS["named_lines"] = """
    SELECT l_orderkey, unnest(list_append(string_split(p_name, ' '), p_type)) AS token
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
PARTS["ordered_skills"] = """
    SELECT l_orderkey AS sk_order, list_sort(list(DISTINCT coalesce(skill, token))) AS raw_skills
    FROM named_lines LEFT JOIN token_skill USING (token) WHERE token IS NOT NULL GROUP BY 1"""

_LOW = "CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice / 10) AS INTEGER) END"
_HIGH = """CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(CASE WHEN o_orderstatus = 'P'
    THEN floor(o_totalprice / 20) ELSE floor(o_totalprice / 5) END AS INTEGER) END"""
_TYPE_TEXT = f"""concat_ws(', ', CASE WHEN o_orderpriority = '5-LOW' THEN 'Internship'
    ELSE {case('o_orderstatus', P.TYPE_TEXT_OF_STATUS)} END,
    {case('c_mktsegment', P.MODE_TEXT_OF_SEGMENT)})"""
_TITLE = f"""CASE WHEN n_nationkey = 24 THEN ' ' ELSE concat_ws(' ',
    {case('o_orderpriority', P.TITLE_PREFIX)}, {case('c_mktsegment', P.ROLE_OF_SEGMENT)},
    {case('o_orderstatus', P.TITLE_SUFFIX)}) END"""
_COUNTRY = f"{listed(P.RAW_COUNTRIES)}[n_nationkey + 1]"

PARTS["full_orders"] = f"""
    SELECT *, {_LOW} AS salary_min, {_HIGH} AS salary_max, {_TYPE_TEXT} AS type_text,
        {_TITLE} AS title, {_COUNTRY} AS raw_country,
        {listed(P.CURRENCIES)}[n_nationkey + 1] AS salary_currency,
        {case('o_orderpriority', P.PERIOD_OF_PRIORITY)} AS salary_period
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN ordered_skills ON sk_order = o_orderkey"""
PARTS["raw_jobs"] = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS slug, CAST(o_custkey AS VARCHAR) AS company_slug, title,
        c_acctbal >= 0 AS ai, o_orderdate AS published, raw_skills AS skills,
        [type_text, 'Internship'] AS types, {case('o_orderpriority', P.LEVEL_OF_PRIORITY)} AS seniority,
        n_name AS city, raw_country AS country, salary_min, salary_max, salary_currency, salary_period
    FROM full_orders"""
PARTS["raw_companies"] = """
    SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, 'logo/' || c_custkey AS logo,
        'https://' || lower(c_mktsegment) || '.example.com' AS url,
        c_name || ' in ' || c_mktsegment AS description, c_nationkey * 10 AS linkedin_staff_count,
        1990 + c_nationkey AS year_founded, c_mktsegment AS company_sector,
        CAST(floor(c_acctbal) AS INTEGER) AS linkedin_follower_count FROM customer"""
PARTS["analysis_jobs"] = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS job_id, strftime(o_orderdate, '%Y_%m') AS published,
        CASE WHEN n_nationkey = 8 THEN ' ' WHEN n_nationkey <> 7 THEN n_name END AS country,
        c_name AS company_name,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'internship'
            ELSE {case('o_orderstatus', P.TYPE_OF_STATUS)} END AS job_type,
        {case('c_mktsegment', P.MODE_OF_SEGMENT)} AS work_mode,
        {case('c_mktsegment', P.ROLE_OF_SEGMENT)} AS standardized_title,
        coalesce({case('o_orderpriority', P.LEVEL_OF_PRIORITY)},
            {case('o_orderstatus', P.LEVEL_OF_STATUS)}) AS seniority_level,
        raw_skills AS skills, salary_min, salary_max
    FROM full_orders"""
PARTS["filled_jobs"] = """
    SELECT job_id, published, coalesce(nullif(trim(country), ''), 'Unknown') AS country, company_name,
        job_type, coalesce(work_mode, 'Unspecified') AS work_mode, standardized_title,
        seniority_level, skills, salary_min, salary_max
    FROM analysis_jobs WHERE skills IS NOT NULL"""
PARTS["postings"] = """
    SELECT * REPLACE (list_distinct(list_transform(skills, lambda s: lower(trim(s)))) AS skills)
    FROM filled_jobs"""
PARTS["skill_rows"] = "SELECT * EXCLUDE (skills), unnest(skills) AS skill FROM postings"
_DIMS = ("published, country, company_name, job_type, work_mode, standardized_title, "
         "seniority_level")

# Sources and sinks -----------------------------------------------------------------

check("scan_csv_postings", """SELECT job_id AS job_slug, standardized_title AS title,
    CAST(to_json(skills) AS VARCHAR) AS skills, country, published, company_name,
    salary_min, salary_max, job_type, work_mode, standardized_title, seniority_level
    FROM analysis_jobs""")
check("scan_parquet_pivot", f"""SELECT skill, count(*) AS cells, CAST(sum(m) AS BIGINT) AS mentions
    FROM (SELECT {_DIMS}, skill, count(DISTINCT job_id) AS m FROM skill_rows GROUP BY ALL)
    GROUP BY skill""")
check("scan_table", """SELECT * EXCLUDE (skills) REPLACE (array_to_string(types, '|') AS types)
    FROM raw_jobs""")
check("scan_distinct_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
check("flatten_postings_json", """SELECT CAST(o_orderkey AS VARCHAR) AS slug,
    CAST(o_custkey AS VARCHAR) AS company_slug, title, FALSE AS premium, c_acctbal >= 0 AS ai,
    o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS published,
    coalesce(array_to_string(list_transform(raw_skills, lambda s: trim(s)), '|'), '') AS skills,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'teamwork' ELSE '' END AS soft_skills,
    CAST(0 AS INTEGER) AS n_tools,
    CASE WHEN o_orderstatus = 'F' THEN replace(type_text, ', ', '|') ELSE 'Remote|Freelancer' END AS types,
    CASE WHEN n_nationkey % 3 <> 0 THEN n_name ELSE '' END AS city, coalesce(raw_country, '') AS country,
    CASE WHEN n_nationkey % 5 = 0 THEN 'Somewhere'
        WHEN n_nationkey % 3 <> 0 AND coalesce(raw_country, '') <> '' THEN n_name || ', ' || raw_country
        WHEN n_nationkey % 3 <> 0 THEN n_name ELSE coalesce(raw_country, '') END AS location,
    coalesce(salary_min, 0) AS salary_min, coalesce(salary_max, 0) AS salary_max,
    CAST(0 AS INTEGER) AS same_as FROM full_orders""")
# An id of 0 counts as no id.
PARTS["identified_orders"] = "SELECT * FROM full_orders WHERE o_orderkey <> 0"
check("rejected_postings_json", """SELECT o_orderkey AS page, CAST(1 AS INTEGER) AS entry,
    'no company' AS reason FROM full_orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, NULL, CASE o_orderkey % 2 WHEN 0 THEN 'no JSON' ELSE 'other JSON' END
    FROM full_orders WHERE o_orderkey % 3 = 0""")
check("normalize_star_json", """
    SELECT DISTINCT 'companies' AS table_name, o_custkey || '|-|' || c_name || '|-|-|-|-|-|false' AS columns FROM identified_orders
    UNION ALL SELECT DISTINCT 'countries', (n_nationkey + 1) || '|-|' || n_name || '|' || n_nationkey % 5 || '|-' FROM identified_orders
    UNION ALL SELECT DISTINCT 'locations', (n_nationkey + 100) || '|-|' || n_name || '|XX|-|-|-|-|0' FROM identified_orders
    UNION ALL SELECT 'job_locations', o_orderkey || '|' || (n_nationkey + 100) FROM identified_orders
    UNION ALL SELECT 'jobs', o_orderkey || '|x' || o_orderkey || '|' || o_custkey || '|' || coalesce(title, '-') || '|-|-|'
        || o_orderpriority || '|-|-|' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || '|'
        || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || coalesce(CAST(salary_min AS VARCHAR), '-') || '|'
        || coalesce(CAST(salary_max AS VARCHAR), '-') || '|-' FROM identified_orders
    UNION ALL SELECT DISTINCT 'types', ascii(o_orderstatus) || '|' || o_orderstatus FROM identified_orders
    UNION ALL SELECT DISTINCT 'types', ascii(o_orderpriority) || '|' || o_orderpriority FROM identified_orders
    UNION ALL SELECT 'job_to_types', o_orderkey || '|' || ascii(o_orderstatus) FROM identified_orders
    UNION ALL SELECT 'job_to_types', o_orderkey || '|' || ascii(o_orderpriority) FROM identified_orders
    UNION ALL SELECT 'rejected', o_orderkey || '|no id' FROM full_orders WHERE o_orderkey = 0""")

PARTS["pivot_cells"] = f"""SELECT {_DIMS}, skill, count(DISTINCT job_id) AS mentions
    FROM skill_rows GROUP BY ALL"""
PARTS["pivot_rows"] = f"""SELECT {_DIMS}, pivot_cells.skill, mentions AS total_jobs, mentions,
    mentions / sum(mentions) OVER (PARTITION BY {_DIMS}) * 100 AS prevalence,
    category AS skill_category FROM pivot_cells LEFT JOIN skill_cat ON skill_cat.skill = pivot_cells.skill"""
for key in ("write_pivot", "skill_pivot"):
    check(key, "SELECT * FROM pivot_rows", "prevalence")
check("write_csv", """SELECT slug, title, CAST(to_json(skills) AS VARCHAR) AS skills,
    CAST(to_json(types) AS VARCHAR) AS types, salary_min FROM raw_jobs""")
check("insert_ignore", """SELECT o_custkey AS company_key, o_orderkey AS source_key,
    o_totalprice AS amount FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""", "amount")
PARTS["latest_orders"] = """SELECT o_custkey AS company_key, o_orderkey AS source_key,
    o_totalprice AS amount FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
check("upsert_update", """SELECT c_custkey AS company_key, CAST(source_key AS BIGINT) AS source_key,
    coalesce(amount, c_acctbal) AS amount FROM customer LEFT JOIN latest_orders ON company_key = c_custkey""",
      "amount")
PARTS["kept_results"] = """SELECT slug, seq, success FROM (
        SELECT 0 AS batch, c_custkey AS slug, CAST(0 AS BIGINT) AS seq, c_acctbal >= 0 AS success FROM customer
        UNION ALL SELECT 1, o_custkey, o_orderkey, o_orderstatus <> 'P' FROM orders)
    QUALIFY row_number() OVER (PARTITION BY slug ORDER BY batch DESC, seq DESC) = 1"""
check("upsert_keep_last", "SELECT * FROM kept_results WHERE success")
check("union_keep_last", "SELECT * FROM kept_results")

_SENIORITY = f"""CASE WHEN title IS NULL OR trim(title) = '' THEN 'Unknown'
    {first_match('title', fv.SENIORITY_PATTERNS)} ELSE 'Unspecified' END"""
check("write_classification_back", f"""SELECT slug, title, ai,
    CASE WHEN ai THEN {_SENIORITY} ELSE seniority END AS seniority FROM raw_jobs""")

PARTS["page_urls"] = """SELECT page_id, CAST(page_id AS VARCHAR) AS slug,
    regexp_replace(replace(replace(url, 'example.com', 'greenhouse.io'), 'example.net', 'jobs.Lever.co'),
        '^http://', '') AS final_url FROM pages"""
_URL_VALID = "coalesce(regexp_matches(final_url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+'), FALSE)"
_URL_TYPE = f"""CASE WHEN NOT {_URL_VALID} THEN 'invalid' {" ".join(
    f"WHEN contains(lower(final_url), {quoted(mark)}) THEN {quoted(name)}"
    for name, mark in fv.URL_TYPE_MARKS)} ELSE 'web' END"""
PARTS["url_rows"] = f"""SELECT slug, final_url, {_URL_TYPE} AS type, {_URL_VALID} AS success,
    CAST(page_id % 5 + 1 AS INTEGER) AS attempts,
    CASE WHEN {_URL_VALID} THEN CAST(200 AS INTEGER) END AS status_code,
    CASE WHEN NOT {_URL_VALID} THEN 'Invalid final URL: ' || final_url END AS error FROM page_urls"""
check("write_url_results", "SELECT * FROM url_rows")
check("url_success_rate", "SELECT avg(CAST(success AS INTEGER)) * 100 AS success_pct FROM url_rows",
      "success_pct")
check("url_is_valid", "SELECT slug, success AS valid FROM url_rows")
check("url_type", "SELECT slug, type FROM url_rows")

# Projections, filters, joins -------------------------------------------------------

PARTS["ctas"] = """SELECT j.slug AS job_slug, j.title, j.skills, j.seniority, j.types, j.country, j.city,
    j.salary_min, j.salary_max, j.salary_currency, j.salary_period, j.published, c.name AS company_name,
    c.company_sector FROM raw_jobs j LEFT JOIN raw_companies c ON j.company_slug = c.slug WHERE j.ai"""
check("cleaned_ctas", """SELECT * REPLACE (array_to_string(skills, '|') AS skills,
    array_to_string(types, '|') AS types) FROM ctas""")
_DATES = "strptime(published, '%Y_%m') BETWEEN DATE '1996-01-01' AND DATE '1999-06-01'"
_FACETS = f"{_DATES} AND standardized_title = 'Data Engineer'"
_ANY = "list_has_any(skills, ['python', 'tableau'])"
check("facet_filter", f"SELECT job_id, {_DIMS} FROM postings WHERE {_FACETS} AND {_ANY}")
check("facet_filter_pivot", f"""SELECT * FROM pivot_rows WHERE {_FACETS}
    AND skill IN ('python', 'tableau')""", "prevalence")
check("filter_any_skill", f"SELECT job_id FROM postings WHERE {_ANY}")
check("filter_salary_range", """SELECT slug, (salary_min + salary_max) / 2 AS salary FROM raw_jobs
    WHERE (salary_min + salary_max) / 2 > 1000 AND (salary_min + salary_max) / 2 < 500000""", "salary")
check("select_sample_ordered", """SELECT slug AS job_slug, title, country, salary_min, salary_period,
    salary_currency, published FROM raw_jobs WHERE salary_min > 0 ORDER BY title, slug LIMIT 5""")
check("drop_missing_fill_defaults", f"SELECT job_id, {_DIMS} FROM filled_jobs")
check("filter_summary", f"""SELECT count(*) AS total, count(*) FILTER ({_FACETS} AND {_ANY}) AS shown,
    (count(*) - count(*) FILTER ({_FACETS} AND {_ANY})) / count(*) * 100 AS reduction_pct FROM postings""",
      "reduction_pct")
check("listings_with_company", """SELECT j.slug, company_slug, title, c.name AS company_name,
    c.logo AS company_logo, c.url AS company_url, c.description AS company_description,
    c.linkedin_staff_count AS company_size, c.year_founded AS company_year_founded, c.company_sector,
    c.linkedin_follower_count FROM raw_jobs j LEFT JOIN raw_companies c ON company_slug = c.slug""")


def group_counts(group: str) -> str:
    return f"""(SELECT a.{group}, a.skill, mentions, total_jobs,
        mentions / total_jobs * 100 AS prevalence
        FROM (SELECT {group}, skill, count(DISTINCT job_id) AS mentions FROM skill_rows GROUP BY ALL) a
        JOIN (SELECT {group}, count(DISTINCT job_id) AS total_jobs FROM postings GROUP BY ALL) b
        ON a.{group} = b.{group})"""


def top_of_group(group: str, n: int, metric: str = "mentions") -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY {metric} DESC, skill)
        AS INTEGER) AS rank FROM {group_counts(group)} QUALIFY rank <= {n}"""


check("join_group_totals", f"SELECT * FROM {group_counts('country')}", "prevalence")
check("orphaned_jobs", """SELECT count(*) AS orphaned_jobs FROM orders LEFT JOIN
    (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL""")
PARTS["line_skills"] = """SELECT l_orderkey AS job_id, split_part(p_name, ' ', 1) AS skill, 'technical' AS category
        FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT l_orderkey, split_part(p_name, ' ', 2), 'tool' FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT l_orderkey, lower(p_type), 'technical' FROM lineitem JOIN part ON l_partkey = p_partkey"""
check("orphaned_skills", """SELECT count(*) AS orphaned_skill_records FROM line_skills WHERE job_id NOT IN
    (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0)""")
check("semi_valid_jobs", """SELECT * FROM (SELECT DISTINCT job_id, skill FROM line_skills)
    WHERE job_id IN (SELECT job_id FROM line_skills GROUP BY job_id HAVING count(DISTINCT skill) >= 10)""")
check("anti_processed", """SELECT DISTINCT o_custkey AS slug FROM orders
    EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal >= 0""")
PARTS["all_pairs"] = """SELECT a.job_id, a.skill AS skill_1, b.skill AS skill_2 FROM skill_rows a
    JOIN skill_rows b ON a.job_id = b.job_id AND a.skill < b.skill"""
PARTS["sized_jobs"] = "SELECT job_id FROM postings WHERE len(skills) >= 2"
PARTS["pair_n"] = """SELECT skill_1, skill_2, count(*) AS mentions FROM all_pairs
    JOIN sized_jobs USING (job_id) GROUP BY ALL"""
check("skill_pair_selfjoin", "SELECT * FROM pair_n")
check("category_lookup", """SELECT r.skill, count(*) AS mentions, any_value(category) AS skill_category
    FROM skill_rows r LEFT JOIN skill_cat c ON r.skill = c.skill GROUP BY r.skill""")
check("currency_lookup", """SELECT salary_currency, CAST(coalesce(rate, 1) AS DECIMAL(12,7)) AS usd_rate, count(*) AS jobs
    FROM raw_jobs LEFT JOIN usd ON salary_currency = currency GROUP BY ALL""")

# Aggregations ----------------------------------------------------------------------

check("skill_pivot_job_ids", f"SELECT {_DIMS}, skill, job_id FROM skill_rows")


def share_of(column: str, rows: str) -> str:
    return f"""(SELECT {column}, count(DISTINCT job_id) AS mentions,
        count(DISTINCT job_id) / (SELECT count(DISTINCT job_id) FROM {rows}) * 100 AS prevalence,
        (SELECT count(DISTINCT job_id) FROM {rows}) AS total_jobs FROM {rows} GROUP BY {column})"""


PARTS["category_rows"] = """SELECT job_id, category AS skill_category FROM skill_rows r
    JOIN skill_cat c ON r.skill = c.skill"""
check("aggregate_pivot", f"SELECT * FROM {share_of('company_name', 'postings')}", "prevalence")
check("skill_frequency", f"""SELECT * FROM {share_of('skill', 'skill_rows')}
    ORDER BY mentions DESC, skill LIMIT 20""", "prevalence")
check("skill_category_frequency", f"""SELECT * FROM {share_of('skill_category', 'category_rows')}
    ORDER BY mentions DESC, skill_category LIMIT 10""", "prevalence")
check("order_by_metric", f"SELECT * FROM {share_of('country', 'postings')} ORDER BY prevalence DESC, country",
      "prevalence")
check("topk", f"""SELECT * FROM {share_of('company_name', 'postings')}
    ORDER BY mentions DESC, company_name LIMIT 10""", "prevalence")
check("monthly_totals", """SELECT published, count(DISTINCT job_id) AS total_jobs FROM postings
    GROUP BY published""")
PARTS["months"] = """SELECT published, count(*) AS jobs,
    row_number() OVER (ORDER BY published) - 1 AS idx FROM postings GROUP BY published"""
PARTS["matrix"] = """SELECT s.skill, m.idx, m.published, coalesce(n, 0) AS mentions,
    coalesce(n, 0) / m.jobs * 100 AS prevalence
    FROM (SELECT DISTINCT skill FROM skill_rows) s CROSS JOIN months m
    LEFT JOIN (SELECT skill, published, count(*) AS n FROM skill_rows GROUP BY ALL) c
    ON c.skill = s.skill AND c.published = m.published"""
check("skill_month_matrix", """SELECT skill, CAST(idx AS INTEGER) AS month_idx, published, mentions,
    prevalence FROM matrix""", "prevalence")
check("skill_timeline", """SELECT skill, published, prevalence FROM matrix
    WHERE skill IN ('python', 'aws', 'nlp')""", "prevalence")
_CHOSEN = f"{_DATES}"
check("facet_values", f"""SELECT facet, value, count(*) AS jobs FROM (
    SELECT 'country' AS facet, country AS value FROM postings WHERE {_DATES}
    UNION ALL SELECT 'company_name', company_name FROM postings WHERE {_DATES}
    UNION ALL SELECT 'job_type', job_type FROM postings WHERE {_DATES}
    UNION ALL SELECT 'standardized_title', standardized_title FROM postings WHERE {_DATES} AND job_type = 'contract'
    UNION ALL SELECT 'seniority_level', seniority_level FROM postings WHERE {_DATES} AND job_type = 'contract')
    GROUP BY ALL HAVING count(*) > 10""")

_FACTOR = "CASE " + " ".join(
    f"WHEN lower(salary_period) IN ({', '.join(quoted(s) for s in spellings)}) THEN {n}"
    for spellings, n in fv.PERIODS_PER_YEAR
) + " ELSE 1 END"


def annual(column: str) -> str:
    return (f"CAST(CAST({column} AS DECIMAL(14,0)) * CAST({_FACTOR} AS DECIMAL(4,0)) * "
            "coalesce(rate, CAST(1 AS DECIMAL(12,7))) AS DECIMAL(24,2))")


PARTS["annual_jobs"] = f"""SELECT * EXCLUDE (rate, currency), coalesce(
        CAST((salary_min_annual_usd + salary_max_annual_usd) * 0.5 AS DECIMAL(24,2)),
        salary_min_annual_usd, salary_max_annual_usd) AS salary_annual_usd
    FROM (SELECT *, {annual('salary_min')} AS salary_min_annual_usd,
        {annual('salary_max')} AS salary_max_annual_usd FROM raw_jobs LEFT JOIN usd ON salary_currency = currency)"""
check("overview_metrics", """SELECT count(*) AS total_jobs, count(DISTINCT company_slug) AS companies,
    avg(coalesce(len(skills), 0)) AS avg_skills_per_job,
    avg(CAST(salary_annual_usd AS DOUBLE)) AS avg_salary_usd, count(salary_annual_usd) AS jobs_with_salary
    FROM annual_jobs""", "avg_skills_per_job avg_salary_usd")
check("salary_annual_usd", """SELECT slug, salary_min_annual_usd, salary_max_annual_usd,
    salary_annual_usd FROM annual_jobs""")
check("dataset_profile", """SELECT min(published) AS first_month, max(published) AS last_month,
    count(DISTINCT country) AS countries, count(DISTINCT company_name) AS companies,
    count(DISTINCT standardized_title) AS roles, count(DISTINCT seniority_level) AS levels,
    (SELECT count(*) FROM skill_rows) AS mentions,
    (SELECT count(DISTINCT skill) FROM skill_rows) AS skills FROM postings""")
check("company_job_counts", """SELECT company_slug, count(*) AS jobs_count,
    count(*) FILTER (ai) AS jobs_ai_count FROM raw_jobs GROUP BY company_slug""")
check("table_counts", """SELECT 'jobs' AS table_name, count(*) AS n_rows FROM orders
    UNION ALL SELECT 'companies', count(*) FROM customer UNION ALL SELECT 'locations', count(*) FROM nation""")
_PROGRESS = ("standardized_title", "seniority_level", "job_type", "work_mode", "country", "salary_max")
check("cleaning_progress", "SELECT count(*) AS total, "
      + ", ".join(f"count({c}) AS has_{c}" for c in _PROGRESS) + " FROM analysis_jobs")
check("distinct_currencies", "SELECT count(DISTINCT salary_currency) AS currencies FROM raw_jobs")

# Windows, groups, levels -----------------------------------------------------------

check("dedupe_earliest", """SELECT job_slug, title, country, array_to_string(skills, '|') AS skills,
    salary_min, salary_max, published FROM (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS job_slug,
            l_returnflag AS title, l_linestatus AS country, [l_returnflag, l_linestatus] AS skills,
            l_linenumber AS salary_min, CAST(l_quantity AS INTEGER) AS salary_max,
            CASE WHEN l_discount < 0.09 THEN l_shipdate END AS published FROM lineitem)
    QUALIFY row_number() OVER (PARTITION BY title, country, skills, salary_min, salary_max
        ORDER BY published ASC NULLS LAST, job_slug) = 1""")
check("share_in_group", """SELECT *, mentions / sum(mentions) OVER (PARTITION BY published, country) * 100
    AS prevalence FROM (SELECT published, country, skill, count(*) AS mentions FROM skill_rows GROUP BY ALL)""",
      "prevalence")
for key, group, n in (
    ("topn_per_group", "published", 5), ("skills_by_group", "job_type", 15),
    ("skills_by_role", "standardized_title", 15), ("skills_by_seniority", "seniority_level", 15),
    ("skills_by_country", "country", 10),
):
    check(key, top_of_group(group, n), "prevalence")
PARTS["level_rows"] = f"""SELECT * FROM {group_counts('seniority_level')}
    WHERE seniority_level IN ({', '.join(quoted(x) for x in fv.SENIORITY_ORDER)})"""
check("cumulative_share", """SELECT seniority_level, skill, prevalence,
    sum(prevalence) OVER (PARTITION BY seniority_level ORDER BY prevalence DESC, skill ROWS UNBOUNDED PRECEDING)
    / sum(prevalence) OVER (PARTITION BY seniority_level) AS cumulative_share FROM level_rows""",
      "prevalence cumulative_share")
check("skill_diversity", """SELECT seniority_level,
    CASE WHEN max(n) > 1 THEN sum(share - (rn - 1) / (n - 1)) / max(n) ELSE 0 END AS concentration_index,
    max(prevalence) / sum(prevalence) AS top_skill_dominance,
    sum(mentions) / max(total_jobs) AS skills_per_job,
    count(*) FILTER (prevalence > 10) AS high_prevalence_skills
    FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY seniority_level) AS n,
        sum(prevalence) OVER w / sum(prevalence) OVER (PARTITION BY seniority_level) AS share
        FROM level_rows WINDOW w AS (PARTITION BY seniority_level ORDER BY prevalence DESC, skill
            ROWS UNBOUNDED PRECEDING)) GROUP BY seniority_level""",
      "concentration_index top_skill_dominance skills_per_job")
check("seniority_patterns", f"""SELECT seniority_level,
    CAST(list_position({listed(fv.SENIORITY_ORDER)}, seniority_level) AS BIGINT) AS level_rank, total_jobs,
    total_skills, rank, skill, prevalence FROM (SELECT *, count(*) OVER (PARTITION BY seniority_level)
        AS total_skills, CAST(row_number() OVER (PARTITION BY seniority_level ORDER BY prevalence DESC, skill)
        AS INTEGER) AS rank FROM level_rows) WHERE rank <= 5""", "prevalence")
check("normalized_level_comparison", """SELECT seniority_level, jobs / max(jobs) OVER () AS total_jobs_normalized,
    skills / max(skills) OVER () AS total_skills_normalized,
    per_job / max(per_job) OVER () AS skills_per_job_normalized
    FROM (SELECT seniority_level, max(total_jobs) AS jobs, count(*) AS skills,
        sum(mentions) / max(total_jobs) AS per_job FROM level_rows GROUP BY seniority_level)""",
      "total_jobs_normalized total_skills_normalized skills_per_job_normalized")

PARTS["progression"] = """SELECT skill, seniority_level, mentions / total_jobs * 100 AS prevalence,
    mentions, total_jobs FROM (SELECT skill, seniority_level, count(*) AS mentions FROM pivot_cells
        WHERE skill IN ('python', 'sql', 'machine learning', 'aws', 'tableau', 'spark') GROUP BY ALL)
    JOIN (SELECT seniority_level, count(DISTINCT job_id) AS total_jobs FROM postings GROUP BY ALL)
    USING (seniority_level)"""
check("skill_progression", "SELECT * FROM progression", "prevalence")
check("peak_level", """SELECT *, CASE WHEN peak_level IN ('Entry-level', 'Junior') THEN 'early specialization'
    WHEN peak_level IN ('Lead', 'Executive') THEN 'leadership-focused' ELSE 'core competency' END AS pattern
    FROM (SELECT skill, max_by(seniority_level, prevalence) AS peak_level, max(prevalence) AS max_prevalence,
        min(prevalence) AS min_prevalence, avg(prevalence) AS avg_prevalence FROM progression GROUP BY skill)""",
      "max_prevalence min_prevalence avg_prevalence")
_CHARTED = ", ".join(quoted(x) for x in fv.PROGRESSION_LEVELS)
PARTS["charted"] = f"SELECT * FROM progression WHERE seniority_level IN ({_CHARTED})"
check("progression_heatmap", "SELECT skill, "
      + ", ".join(f"""coalesce(max(prevalence) FILTER (seniority_level = '{x}'), 0) AS "{x}\""""
                  for x in fv.PROGRESSION_LEVELS)
      + """, sum(prevalence) / (SELECT count(DISTINCT seniority_level) FROM charted) AS mean_prevalence
    FROM charted GROUP BY skill""",
      [f'"{x}"' for x in fv.PROGRESSION_LEVELS] + ["mean_prevalence"])
check("order_by_level", f"""SELECT s.skill, l.seniority_level,
    CAST(list_position({listed(fv.PROGRESSION_LEVELS)}, l.seniority_level) AS BIGINT) AS level_rank,
    coalesce(c.prevalence, 0) AS prevalence
    FROM (SELECT DISTINCT skill FROM charted) s CROSS JOIN (SELECT DISTINCT seniority_level FROM charted) l
    LEFT JOIN charted c ON c.skill = s.skill AND c.seniority_level = l.seniority_level""", "prevalence")
check("top_by_avg_prevalence", """SELECT skill, avg(prevalence) AS avg_prevalence FROM progression
    GROUP BY skill ORDER BY avg_prevalence DESC, skill LIMIT 3""", "avg_prevalence")
check("level_specific_skills", """SELECT seniority_level, skill, prevalence AS level_prevalence,
    overall AS overall_avg_prevalence, prevalence / overall AS importance_ratio,
    prevalence - overall AS prevalence_difference, CAST(row_number() OVER (PARTITION BY seniority_level
        ORDER BY prevalence / overall DESC, prevalence DESC, skill) AS INTEGER) AS rank
    FROM level_rows JOIN (SELECT skill, avg(prevalence) AS overall FROM progression GROUP BY skill) USING (skill)
    WHERE prevalence / overall >= 1.02 QUALIFY rank <= 3""",
      "level_prevalence overall_avg_prevalence importance_ratio prevalence_difference")
PARTS["role_top"] = top_of_group("standardized_title", 20)
PARTS["role_ten"] = "SELECT * FROM role_top WHERE rank <= 10"
check("role_comparison", "SELECT skill, " + ", ".join(
    f"""coalesce(max(prevalence) FILTER (standardized_title = '{r}'), 0) AS "{r}\"""" for r in P.ROLES)
    + " FROM role_ten GROUP BY skill", [f'"{r}"' for r in P.ROLES])
check("top_rows_by_mean", """SELECT skill, sum(prevalence) / (SELECT count(DISTINCT standardized_title)
    FROM role_ten) AS mean_prevalence FROM role_ten GROUP BY skill ORDER BY mean_prevalence DESC, skill LIMIT 15""",
      "mean_prevalence")
_ROLES = """SELECT standardized_title, array_to_string(list(skill ORDER BY prevalence DESC, skill), ', ')
    AS top_skills, sum(prevalence) / least(10, (SELECT count(DISTINCT skill) FROM role_ten)) AS skill_intensity
    FROM role_ten GROUP BY standardized_title"""
check("role_specializations", _ROLES, "skill_intensity")
_UNIVERSAL = """SELECT kind, CAST(row_number() OVER (PARTITION BY kind
        ORDER BY avg_prevalence DESC, skill) AS INTEGER) AS rank, skill, role_count, total_roles,
    CASE WHEN kind = 'specialized' THEN role END AS primary_role, avg_prevalence
    FROM (SELECT *, CASE WHEN role_count >= total_roles * 0.6 AND avg_prevalence > 15 THEN 'universal'
            WHEN role_count = 1 AND avg_prevalence > 25 THEN 'specialized' END AS kind
        FROM (SELECT skill, count(*) AS role_count, (SELECT count(DISTINCT standardized_title) FROM role_top)
            AS total_roles, min(standardized_title) AS role, avg(prevalence) AS avg_prevalence
            FROM role_top GROUP BY skill)) WHERE kind IS NOT NULL QUALIFY rank <= 10"""
check("universal_specialized", _UNIVERSAL, "avg_prevalence")

# Sets and pairs --------------------------------------------------------------------

check("distinct_rows", "SELECT DISTINCT job_id, skill FROM line_skills")
check("distinct_skill_details", """SELECT DISTINCT job_id AS job_slug, skill AS skill_name,
    category AS skill_category FROM line_skills""")


def top_pairs(n: int, fewest: int) -> str:
    return f"""(SELECT * FROM (SELECT skill_1, skill_2, mentions,
        mentions / (SELECT count(*) FROM postings) * 100 AS prevalence FROM pair_n
        ORDER BY mentions DESC, skill_1, skill_2 LIMIT {n}) WHERE mentions >= {fewest})"""


check("skill_pairs", f"SELECT * FROM {top_pairs(20, 10)}", "prevalence")
check("union_of_pair_skills", f"""SELECT skill_1 AS skill FROM {top_pairs(20, 10)}
    UNION SELECT skill_2 FROM {top_pairs(20, 10)}""")
PARTS["skill_n"] = "SELECT skill, count(*) AS n FROM skill_rows GROUP BY skill"
PARTS["overlap"] = """SELECT skill_1, skill_2, both_n AS jobs_with_both,
    a.n + b.n - both_n AS jobs_with_either, both_n / (a.n + b.n - both_n) AS co_occurrence_rate
    FROM (SELECT skill_1, skill_2, count(*) AS both_n FROM all_pairs GROUP BY ALL)
    JOIN skill_n a ON a.skill = skill_1 JOIN skill_n b ON b.skill = skill_2"""
_SYNERGY = """CASE WHEN co_occurrence_rate > 0.4 THEN 'Very High Synergy'
    WHEN co_occurrence_rate > 0.25 THEN 'High Synergy' WHEN co_occurrence_rate > 0.1 THEN 'Medium Synergy'
    ELSE 'Low Synergy' END AS learning_synergy"""
check("job_set_overlap", f"""SELECT overlap.* FROM overlap JOIN {top_pairs(40, 10)} USING (skill_1, skill_2)""",
      "co_occurrence_rate")
check("pair_synergy", f"""SELECT skill_1, skill_2, {_SYNERGY} FROM overlap
    JOIN {top_pairs(200, 10)} USING (skill_1, skill_2)""")
PARTS["pair_labels"] = """SELECT skill_1, skill_2, CASE WHEN coalesce(a.category, 'Other') = coalesce(b.category, 'Other')
        THEN 'Same Domain: ' || coalesce(a.category, 'Other')
        ELSE 'Cross-Domain: ' || coalesce(a.category, 'Other') || ' + ' || coalesce(b.category, 'Other') END
    AS combination_type FROM pair_n LEFT JOIN skill_cat a ON a.skill = skill_1
    LEFT JOIN skill_cat b ON b.skill = skill_2"""
check("pair_domain_label", "SELECT * FROM pair_labels")
def prevalent_pairs(n: int) -> str:
    return f"""SELECT skill_1, skill_2, mentions, prevalence, combination_type, {_SYNERGY}
    FROM {top_pairs(2 * n, 3)} JOIN pair_labels USING (skill_1, skill_2) JOIN overlap USING (skill_1, skill_2)
    ORDER BY mentions DESC, skill_1, skill_2 LIMIT {n}"""


check("pair_prevalence", prevalent_pairs(20), "prevalence")

# Scalar functions ------------------------------------------------------------------

_RULED = f"""CASE WHEN regexp_matches(lower(country), {quoted(fv.UNITED_STATES_PATTERN)}) THEN 'United States'
    {first_match('country', fv.COUNTRY_RULES)} ELSE
    CASE WHEN trim(coalesce(cut, '')) = '' OR upper(cut) IN ('[ ]', 'UNKNOWN') THEN 'Unknown' ELSE cut END END"""
PARTS["clean_countries"] = f"""SELECT slug, country AS country_original, trim(array_to_string(list_transform(
        regexp_extract_all({_RULED}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'),
        lambda t: upper(t[1]) || lower(t[2:])), '')) AS country
    FROM (SELECT slug, country, trim(split_part(trim(split_part(country, ':', 1)), ';', 1)) AS cut FROM raw_jobs)"""
check("standardize_country", "SELECT slug, country, country_original FROM clean_countries")
_GENERIC = ", ".join(quoted(s) for s in fv.GENERIC_SKILLS)
check("remove_generic_skills", f"""SELECT slug, array_to_string(
    list_filter(skills, lambda s: s NOT IN ({_GENERIC})), '|') AS skills FROM raw_jobs""")
check("month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y_%m') AS published FROM orders")


def _terms(words) -> str:
    return "|".join(words)


_TYPE_CLEAN = "regexp_replace(lower(types[1]), '[^a-zA-Z\\s,;/-]', ' ', 'g')"
_JOB_TYPE = "CASE " + first_match(
    _TYPE_CLEAN,
    [("internship", _terms(fv.INTERNSHIP_TERMS))] + [(n, _terms(t)) for n, t in fv.JOB_TYPE_TERMS],
) + " END"
_WORK_MODE = "CASE " + first_match(
    _TYPE_CLEAN, [(n, _terms(t)) for n, t in fv.WORK_MODE_TERMS]) + " END"
check("job_type_mode", f"SELECT slug, {_JOB_TYPE} AS job_type, {_WORK_MODE} AS work_mode FROM raw_jobs")
check("extract_seniority", f"SELECT slug, title, {_SENIORITY} AS seniority_level FROM raw_jobs")
PARTS["spelled_skills"] = """SELECT o_orderkey, o_orderpriority AS pr, raw_skills,
    CASE o_orderpriority WHEN '1-URGENT' THEN '[''' || array_to_string(raw_skills, ''', ''') || ''']'
        WHEN '2-HIGH' THEN array_to_string(raw_skills, ' ,, ') WHEN '3-MEDIUM' THEN CAST(to_json(raw_skills) AS VARCHAR)
        WHEN '4-NOT SPECIFIED' THEN '[''' || array_to_string(raw_skills, ', ') ELSE '  ' END AS written FROM full_orders"""
check("parse_skill_list", """SELECT o_orderkey, CASE
    WHEN raw_skills IS NULL OR pr = '5-LOW' THEN ''
    WHEN pr IN ('1-URGENT', '3-MEDIUM') THEN array_to_string(raw_skills, '|')
    WHEN pr = '2-HIGH' THEN array_to_string(list_transform(raw_skills, lambda s: trim(s)), '|')
    ELSE '[''' || array_to_string(list_transform(raw_skills, lambda s: trim(s)), '|') END AS skills
    FROM spelled_skills""")
PARTS["csv_parts"] = """SELECT o_orderkey, list_filter(list_transform(string_split(coalesce(written, ''), ','),
    lambda s: trim(s)), lambda s: s <> '') AS parts FROM spelled_skills"""
check("split_csv_skills", """SELECT o_orderkey, CAST(len(parts) AS INTEGER) AS n,
    array_to_string(parts, '|') AS skills FROM csv_parts""")
check("normalize_skill_array", """SELECT DISTINCT slug, lower(trim(s)) AS skill
    FROM (SELECT slug, unnest(skills) AS s FROM raw_jobs) WHERE trim(s) <> ''""")
PARTS["raw_rows"] = "SELECT slug, unnest(skills) AS s FROM raw_jobs"
check("unpivot_skill_arrays", """SELECT slug AS job_slug, s AS skill_name, 'technical' AS skill_category FROM raw_rows
    UNION ALL SELECT slug, s, 'soft' FROM raw_rows WHERE s = 'Communication'
    UNION ALL SELECT slug, s, 'tool' FROM raw_rows WHERE s IN ('Excel', 'Tableau')
    UNION ALL SELECT slug, s, 'language' FROM raw_rows WHERE s IN ('Python', 'R', 'SQL')
    UNION ALL SELECT slug, s, 'framework' FROM raw_rows WHERE s IN ('TensorFlow', 'PyTorch')""")
check("null_sentinel_dates", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
    THEN o_orderdate END AS published FROM orders""")
check("compose_location", """SELECT o_orderkey, CASE WHEN n_nationkey % 5 = 0 THEN 'Somewhere'
    WHEN n_nationkey % 3 <> 0 AND coalesce(raw_country, '') <> '' THEN n_name || ', ' || raw_country
    WHEN n_nationkey % 3 <> 0 THEN n_name ELSE coalesce(raw_country, '') END AS location FROM full_orders""")
check("employment_types", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN replace(type_text, ', ', '|')
    WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '' END AS types FROM full_orders""")
check("month_range_filter", """SELECT job_id, published FROM postings
    WHERE strptime(published, '%Y_%m') BETWEEN DATE '1996-03-01' AND DATE '1998-02-01'""")
check("skills_count", "SELECT slug, CAST(coalesce(len(skills), 0) AS INTEGER) AS skills_count FROM raw_jobs")
check("dates_to_parts", """SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN CAST(year(o_orderdate) AS INTEGER) END AS published_year,
    CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN CAST(month(o_orderdate) AS INTEGER) END AS published_month
    FROM orders""")
check("exchange_rate_rows", """
    SELECT c_custkey, 'EUR' AS currency_code, CAST(1.0 / (abs(c_acctbal) / 100 + 1) AS DECIMAL(12,6)) AS rate_to_usd FROM customer
    UNION ALL SELECT c_custkey, 'JPY', CAST(1.0 / CAST(c_nationkey + 2 AS DOUBLE) AS DECIMAL(12,6)) FROM customer
    UNION ALL SELECT c_custkey, 'USD', CAST(1 AS DECIMAL(12,6)) FROM customer""")

# Trends ----------------------------------------------------------------------------

# Exponential smoothing in closed form, alpha = 0.3.
PARTS["smooth"] = """SELECT t.skill, t.idx, any_value(t.mentions) AS mentions,
    any_value(t.prevalence) AS prevalence,
    sum(CASE WHEN j.idx = 0 THEN pow(0.7, t.idx) ELSE 0.3 * pow(0.7, t.idx - j.idx) END * j.mentions) AS sm,
    sum(CASE WHEN j.idx = 0 THEN pow(0.7, t.idx) ELSE 0.3 * pow(0.7, t.idx - j.idx) END * j.prevalence) AS sp
    FROM matrix t JOIN matrix j ON j.skill = t.skill AND j.idx <= t.idx GROUP BY t.skill, t.idx"""
check("ewma", """SELECT skill, CAST(idx AS INTEGER) AS month_idx, prevalence AS value,
    sp AS smoothed FROM smooth""", "value smoothed")


def growth(column: str) -> str:
    return f"""(SELECT skill, CASE WHEN max(abs(now)) < max(eps) THEN 0.0 ELSE greatest(-999.0, least(999.0,
        avg((now - (prev + eps)) / (prev + eps)) * 100)) END AS growth
        FROM (SELECT skill, {column} AS now, lag({column}) OVER (PARTITION BY skill ORDER BY idx) AS prev,
            (SELECT 1e-6 * max(abs({column})) + 1e-12 FROM smooth) AS eps FROM smooth)
        GROUP BY skill)"""


check("mom_growth", """SELECT skill, CAST(idx AS INTEGER) AS month_idx,
    (sm - (prev + eps)) / (prev + eps) AS mom_growth FROM (
        SELECT skill, idx, sm, lag(sm) OVER (PARTITION BY skill ORDER BY idx) AS prev,
            (SELECT 1e-6 * max(abs(sm)) + 1e-12 FROM smooth) AS eps FROM smooth) WHERE idx > 0""", "mom_growth")
check("growth_rates", f"SELECT skill, growth AS growth_pct FROM {growth('sm')}", "growth_pct")
PARTS["n_months"] = "SELECT count(*) AS n FROM months"
PARTS["rolling"] = """SELECT *, CASE WHEN previous_avg > 0 THEN (recent_avg - previous_avg) / previous_avg * 100
        ELSE 0.0 END AS momentum,
    CASE WHEN start_value > 0 AND n > 1 THEN (pow(current_value / start_value, 12.0 / (n - 1)) - 1) * 100
        ELSE 0.0 END AS cagr,
    CASE WHEN peak > 0 THEN current_value / peak ELSE 0.0 END AS peak_ratio
    FROM (SELECT skill, max(n) AS n, max(sp) FILTER (idx = 0) AS start_value,
        max(sp) FILTER (idx = n - 1) AS current_value, max(sp) AS peak,
        max(sm) FILTER (idx = n - 1) AS current_mentions,
        CASE WHEN max(n) >= 12 THEN avg(sp) FILTER (idx >= n - 6) END AS recent_avg,
        CASE WHEN max(n) >= 12 THEN avg(sp) FILTER (idx >= n - 12 AND idx < n - 6) END AS previous_avg,
        regr_slope(sp, idx) AS slope, regr_intercept(sp, idx) AS intercept,
        avg(mentions) AS avg_mentions, sum(mentions) AS total_mentions,
        avg(mentions) FILTER (idx < n - 1) AS baseline
        FROM smooth, n_months GROUP BY skill)"""
check("recent_vs_previous", """SELECT skill, recent_avg, previous_avg, momentum AS recent_momentum_pct
    FROM rolling""", "recent_avg previous_avg recent_momentum_pct")
check("cagr", "SELECT skill, cagr AS cagr_pct FROM rolling", "cagr_pct")
check("momentum_peak", """SELECT skill, momentum AS recent_momentum_pct, current_value, peak_ratio
    FROM rolling""", "recent_momentum_pct current_value peak_ratio")
check("recent_percentile", """SELECT s.skill, CASE WHEN max(n) >= 6
    THEN count(*) FILTER (idx >= n - 6 AND sp <= current_value) / 6 ELSE 0.5 END AS recent_percentile
    FROM smooth s JOIN rolling r USING (skill) GROUP BY s.skill""", "recent_percentile")
check("ols_trend", "SELECT skill, slope AS trend_slope, intercept AS trend_intercept FROM rolling",
      "trend_slope trend_intercept")
PARTS["residual_shape"] = """SELECT skill, CASE WHEN avg(abs(r)) > 0 THEN stddev_pop(r) / avg(abs(r)) ELSE 0 END
    AS nonlinearity FROM (SELECT s.skill, sp - (intercept + slope * idx) AS r
        FROM smooth s JOIN rolling g ON g.skill = s.skill) GROUP BY skill"""
check("nonlinearity", "SELECT * FROM residual_shape", "nonlinearity")
PARTS["kept_skills"] = """SELECT skill FROM matrix GROUP BY skill
    HAVING avg(prevalence) >= 1 AND avg(mentions) >= 5 AND count(*) >= 8"""
PARTS["metrics"] = f"""SELECT r.skill, cagr AS CAGR_pct, current_value AS current_prevalence,
    avg_mentions AS avg_mentions_per_month, CAST(total_mentions AS BIGINT) AS total_mentions, peak_ratio,
    slope AS trend_slope, ln(1 + current_mentions) AS trend_confidence, gm.growth AS growth_mentions_pct,
    gp.growth AS growth_prevalence_pct, baseline AS baseline_mentions, nonlinearity,
    CASE WHEN baseline < 5 THEN 0.2 * momentum + 0.8 * gm.growth
        WHEN baseline < 20 THEN 0.5 * momentum + 0.5 * gm.growth
        ELSE 0.8 * momentum + 0.2 * gm.growth END AS recent_momentum_pct,
    baseline >= 5 AS growth_reliability
    FROM rolling r JOIN kept_skills USING (skill) JOIN residual_shape USING (skill)
    JOIN {growth('sm')} gm ON gm.skill = r.skill JOIN {growth('sp')} gp ON gp.skill = r.skill"""
check("hybrid_momentum", """SELECT skill, baseline_mentions, growth_reliability, recent_momentum_pct
    FROM metrics""", "baseline_mentions recent_momentum_pct")
_FRACTIONS = {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
check("momentum_quantiles", "SELECT " + ", ".join(
    f"quantile_cont(recent_momentum_pct, {q}) AS {n}" for n, q in _FRACTIONS.items())
    + " FROM metrics", " ".join(_FRACTIONS))
check("index_quantiles", "SELECT " + ", ".join(
    f"m[CAST(floor({q} * len(m)) AS INTEGER) + 1] AS {n}" for n, q in _FRACTIONS.items())
    + " FROM (SELECT list_sort(list(recent_momentum_pct)) AS m FROM metrics)", " ".join(_FRACTIONS))


def label(growth_: str, current: str, momentum: str, slope: str, p25: str, p75: str) -> str:
    hot, stable, niche, declining, emerging = (quoted(x) for x in fv.TREND_LABELS)
    return f"""CASE WHEN {current} < 2 AND {growth_} > 20 THEN {emerging}
        WHEN {growth_} > 10 AND {current} > 5 AND {momentum} >= {p75} THEN {hot}
        WHEN {growth_} < -5 AND {current} <= 50 THEN {declining}
        WHEN {growth_} >= -5 AND {slope} < -0.08 AND {momentum} <= {p25} THEN
            CASE WHEN {current} > 50 AND {slope} >= -0.12 THEN {hot} ELSE {declining} END
        WHEN {current} < 5 AND abs({growth_}) < 8 AND {slope} > -0.05 THEN {niche} ELSE {stable} END"""


PARTS["trends"] = f"""SELECT *, recent_momentum_pct * trend_confidence AS volume_adjusted_score,
    {label('CAGR_pct', 'current_prevalence', 'recent_momentum_pct', 'trend_slope',
           '(SELECT quantile_cont(recent_momentum_pct, 0.25) FROM metrics)',
           '(SELECT quantile_cont(recent_momentum_pct, 0.75) FROM metrics)')} AS trend_category FROM metrics"""
_HOT, _STABLE, _NICHE, _DECLINING, _EMERGING = (quoted(x) for x in fv.TREND_LABELS)
PARTS["flagged"] = f"""SELECT *, trend_category = {_EMERGING} AS is_emerging,
    trend_category = {_DECLINING} AS is_declining, trend_category = {_HOT} AS is_growing,
    trend_category = {_STABLE} AS is_stable, trend_category = {_NICHE} AS is_special FROM trends"""
check("trend_category", "SELECT skill, trend_category FROM trends")
check("trend_flags", """SELECT skill, is_emerging, is_declining, is_growing, is_stable, is_special
    FROM flagged""")
check("skill_trends", "SELECT * FROM flagged",
      "CAGR_pct current_prevalence avg_mentions_per_month peak_ratio trend_slope trend_confidence "
      "growth_mentions_pct growth_prevalence_pct baseline_mentions nonlinearity recent_momentum_pct "
      "volume_adjusted_score")
check("log_volume_score", "SELECT skill, trend_confidence, volume_adjusted_score FROM trends",
      "trend_confidence volume_adjusted_score")
PARTS["processed"] = f"""SELECT r.skill, growth AS growth_pct, cagr, momentum AS recent_momentum,
    current_value AS current_prevalence, peak_ratio, slope, intercept, nonlinearity
    FROM rolling r JOIN residual_shape USING (skill) JOIN {growth('sp')} g ON g.skill = r.skill"""
_SORTED = "(SELECT list_sort(list(recent_momentum)) FROM processed)"
check("process_trends", f"""SELECT *, {label(
    'cagr', 'current_prevalence', 'recent_momentum', 'slope',
    f'{_SORTED}[(SELECT CAST(floor(0.25 * count(*)) AS INTEGER) FROM processed) + 1]',
    f'{_SORTED}[(SELECT CAST(floor(0.75 * count(*)) AS INTEGER) FROM processed) + 1]')} AS trend_category
    FROM processed""",
      "growth_pct cagr recent_momentum current_prevalence peak_ratio slope intercept nonlinearity")
check("keep_category", f"""SELECT skill, recent_momentum_pct, trend_category FROM trends
    WHERE trend_category = {_DECLINING} ORDER BY recent_momentum_pct DESC, skill LIMIT 10""", "recent_momentum_pct")
check("trend_summary", "SELECT trend_category, count(*) AS skill_count, " + ", ".join(
    f"round(avg({c}), 3) AS {c}_mean, round(stddev_samp({c}), 3) AS {c}_std"
    for c in ("current_prevalence", "recent_momentum_pct", "trend_slope"))
    + ", round(avg(CAGR_pct), 3) AS CAGR_pct_mean FROM trends GROUP BY trend_category",
      "current_prevalence_mean current_prevalence_std recent_momentum_pct_mean recent_momentum_pct_std "
      "trend_slope_mean trend_slope_std CAGR_pct_mean")
check("category_means", "SELECT trend_category, count(*) AS skill_count, " + ", ".join(
    f"round(avg({c}), 2) AS {c}" for c in ("current_prevalence", "volume_adjusted_score",
                                           "avg_mentions_per_month", "total_mentions"))
    + " FROM trends GROUP BY trend_category",
      "current_prevalence volume_adjusted_score avg_mentions_per_month total_mentions")
check("trend_distribution", """SELECT trend_category, count(*) AS skill_count,
    count(*) / sum(count(*)) OVER () AS share FROM trends GROUP BY trend_category""", "share")
_CORRELATED = ("current_prevalence", "trend_slope", "recent_momentum_pct", "CAGR_pct", "peak_ratio",
               "nonlinearity")
check("metric_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS metric_1, '{b}' AS metric_2, corr({a}, {b}) AS correlation FROM trends"
    for a in _CORRELATED for b in _CORRELATED), "correlation")
_PROFILED = _CORRELATED[:5]
check("normalized_category_profile", "SELECT trend_category, " + ", ".join(
    f"(avg({c}) - (SELECT min({c}) FROM trends)) / (SELECT max({c}) - min({c}) FROM trends) AS {c}"
    for c in _PROFILED) + " FROM trends GROUP BY trend_category", " ".join(_PROFILED))
_MARKS = (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))
check("category_box_stats", "SELECT trend_category, " + ", ".join(
    f"quantile_cont({c}, {q}) AS {n}_{m}"
    for c, n in (("current_prevalence", "prevalence"), ("recent_momentum_pct", "momentum"))
    for m, q in _MARKS) + " FROM trends GROUP BY trend_category",
      " ".join(f"{n}_{m}" for n in ("prevalence", "momentum") for m, _ in _MARKS))
_SIDE = "skill, recent_momentum_pct, current_prevalence"
check("top_emerging_declining", f"""SELECT * FROM (SELECT 'emerging' AS side, {_SIDE} FROM flagged
        WHERE is_emerging ORDER BY recent_momentum_pct DESC, skill LIMIT 15)
    UNION ALL SELECT * FROM (SELECT 'declining', {_SIDE} FROM flagged WHERE is_declining
        ORDER BY recent_momentum_pct, skill LIMIT 15)""", "recent_momentum_pct current_prevalence")


def leading(kind: str, category: str) -> str:
    return f"""SELECT * FROM (SELECT '{kind}', skill, recent_momentum_pct FROM trends
        WHERE trend_category = {category} ORDER BY recent_momentum_pct DESC, skill LIMIT 5)"""


check("trend_insights", f"""
    SELECT 'market_health' AS kind, 'emerging_skills' AS name, CAST(count(*) FILTER (is_emerging) AS DOUBLE) AS value FROM flagged
    UNION ALL SELECT 'market_health', 'growing_skills', count(*) FILTER (is_growing) FROM flagged
    UNION ALL SELECT 'market_health', 'declining_skills', count(*) FILTER (is_declining) FROM flagged
    UNION ALL SELECT 'market_health', 'innovation_ratio',
        count(*) FILTER (is_emerging) / greatest(count(*) FILTER (is_declining), 1) FROM flagged
    UNION ALL {leading('emerging', _EMERGING)} UNION ALL {leading('growing', _HOT)}
    UNION ALL {leading('declining', _DECLINING)}""", "value")

# Classification --------------------------------------------------------------------

PARTS["centroid_cells"] = """SELECT label, position, avg(x) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings)
    GROUP BY ALL"""
PARTS["unit_cells"] = """SELECT label, position, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x
    FROM centroid_cells"""
check("category_centroids", """SELECT label AS category, CAST(position AS INTEGER) AS position, x
    FROM unit_cells""", "x")
PARTS["centroid_lists"] = "SELECT label, list(x ORDER BY position) AS v FROM unit_cells GROUP BY label"
PARTS["cosines"] = """SELECT vec_id, c.label AS category,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings CROSS JOIN centroid_lists c"""
check("similarity_matrix", """SELECT vec_id, CAST(category AS VARCHAR) AS category,
    score AS similarity_score FROM cosines""", "similarity_score")
check("nearest_category", """SELECT vec_id, CASE WHEN score > 0.47 THEN CAST(category AS VARCHAR)
    ELSE 'Other' END AS standardized_title, score AS similarity_score FROM cosines
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, category) = 1""", "similarity_score")

# Salaries --------------------------------------------------------------------------

PARTS["paid"] = """SELECT *, (salary_min + salary_max) / 2 AS salary FROM postings
    WHERE (salary_min + salary_max) / 2 > 1000 AND (salary_min + salary_max) / 2 < 500000"""
PARTS["residuals"] = """SELECT *, salary - baseline AS residual FROM (SELECT *,
    avg(salary) OVER (PARTITION BY company_name, published, country) AS baseline FROM paid)"""
PARTS["residual_rows"] = "SELECT job_id, residual, unnest(skills) AS skill FROM residuals"
check("salary_baseline_residual", "SELECT job_id, salary, baseline, residual FROM residuals",
      "salary baseline residual")
check("salary_baseline_fit", """SELECT count(*) AS jobs,
    1 - sum(residual * residual) / (var_pop(salary) * count(*)) AS r2 FROM residuals""", "r2")
_CONTROLS = "work_mode, job_type"
check("job_skill_rows", f"""SELECT skill, job_id, {_CONTROLS} FROM skill_rows WHERE skill IN
    (SELECT skill FROM skill_n WHERE n >= 5)""")
check("job_skill_matrix", "SELECT job_id, " + ", ".join(
    f"""CAST(list_contains(skills, '{s}') AS INTEGER) AS "{s}\""""
    for s in sorted({v.strip().lower() for v in P.SKILL_OF_TOKEN.values()}))
    + f", {_CONTROLS} FROM postings")
PARTS["ranked_skills"] = """SELECT row_number() OVER (ORDER BY count(*) DESC, skill) - 1 AS index, skill,
    count(*) AS jobs FROM skill_rows GROUP BY skill HAVING count(*) >= 5"""
check("skill_dictionary", "SELECT * FROM ranked_skills")
check("job_skill_vectors", f"""SELECT job_id, coalesce(indices, '') AS indices, {_CONTROLS} FROM postings LEFT JOIN (
    SELECT job_id, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS indices
    FROM skill_rows JOIN ranked_skills USING (skill) GROUP BY job_id) USING (job_id)""")
PARTS["residual_skill"] = """SELECT skill, count(*) AS n, sum(residual) AS s FROM residual_rows
    GROUP BY skill HAVING count(*) >= 5"""
PARTS["residual_all"] = "SELECT count(*) AS n, sum(residual) AS s FROM residuals"
PARTS["premiums"] = """SELECT skill, k.n AS jobs,
    k.s / k.n - CASE WHEN a.n > k.n THEN (a.s - k.s) / (a.n - k.n) END AS dollar_premium,
    k.n / a.n AS prevalence FROM residual_skill k, residual_all a"""
check("skill_premium", "SELECT * FROM premiums", "dollar_premium prevalence")
PARTS["interactions"] = """SELECT skill_1, skill_2, n_ab AS jobs,
    s_ab / n_ab - (x.s - s_ab) / nullif(x.n - n_ab, 0) - (y.s - s_ab) / nullif(y.n - n_ab, 0)
        + (a.s - x.s - y.s + s_ab) / nullif(a.n - x.n - y.n + n_ab, 0) AS synergy
    FROM (SELECT p.skill AS skill_1, q.skill AS skill_2, count(*) AS n_ab, sum(p.residual) AS s_ab
        FROM residual_rows p JOIN residual_rows q ON p.job_id = q.job_id AND p.skill < q.skill GROUP BY ALL)
    JOIN residual_skill x ON x.skill = skill_1 JOIN residual_skill y ON y.skill = skill_2, residual_all a"""
_INTERACTIONS = """SELECT * FROM interactions WHERE synergy IS NOT NULL
    ORDER BY abs(synergy) DESC, skill_1, skill_2 LIMIT 20"""
check("skill_interactions", _INTERACTIONS, "synergy")
# Ridge regression of the residual: normal equations of centred features, solved by
# Gauss and Jordan, one column a step; the right-hand side is the last column.
PARTS["effect_rows"] = """SELECT job_id, residual, unnest(list_concat(list_transform(skills, lambda s: 'skill=' || s),
        ['work_mode=' || coalesce(work_mode, 'Unknown'), 'job_type=' || coalesce(job_type, 'Unknown')])) AS feature
    FROM residuals"""
PARTS["effect_n"] = """SELECT feature, count(*) AS n, sum(residual) AS s, row_number() OVER (ORDER BY feature) AS i
    FROM effect_rows GROUP BY feature HAVING count(*) >= 5"""
PARTS["effect_pairs"] = """SELECT x.i, y.i AS j, count(*) AS together FROM effect_rows a JOIN effect_rows b USING (job_id)
    JOIN effect_n x ON x.feature = a.feature JOIN effect_n y ON y.feature = b.feature GROUP BY ALL"""
PARTS["effect_cells"] = f"""SELECT x.i, y.i AS j, coalesce(together, 0) - x.n * y.n / a.n
        + CASE WHEN x.i = y.i THEN {salaries.RIDGE} ELSE 0 END AS v
    FROM effect_n x CROSS JOIN effect_n y LEFT JOIN effect_pairs p ON p.i = x.i AND p.j = y.i, residual_all a
    UNION ALL SELECT i, (SELECT count(*) + 1 FROM effect_n), x.s - x.n * a.s / a.n FROM effect_n x, residual_all a"""
PARTS["effect_lists"] = """SELECT list(line ORDER BY i) AS m FROM (
    SELECT i, list(CAST(v AS DOUBLE) ORDER BY j) AS line FROM effect_cells GROUP BY i)"""
PARTS["solve_walk"] = """SELECT CAST(0 AS BIGINT) AS step, m FROM effect_lists
    UNION ALL SELECT step + 1, list_transform(m, lambda line, i: CASE WHEN i = step + 1
        THEN list_transform(line, lambda x: x / line[step + 1])
        ELSE list_transform(line, lambda x, j: x - line[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) END)
    FROM solve_walk WHERE step < len(m)"""
PARTS["effects"] = """SELECT feature, n, s, m[i][len(m) + 1] AS b FROM effect_n,
    (SELECT m FROM solve_walk WHERE step = len(m))"""
check("skill_effects", """SELECT feature, jobs, round(b, 3) + 0.0 AS coefficient FROM (SELECT feature, n AS jobs, b FROM effects
    UNION ALL SELECT '(intercept)', a.n, (a.s - (SELECT coalesce(sum(b * n), 0) FROM effects)) / a.n FROM residual_all a)""")
# With (C + ridge) b = r the squares left are those of the target less b r and ridge b b.
PARTS["effects_r2"] = f"""SELECT a.n AS jobs, (SELECT sum(b * (e.s - e.n * a.s / a.n) + {salaries.RIDGE} * b * b) FROM effects e)
    / (SELECT var_pop(residual) * count(*) FROM residuals) AS r2 FROM residual_all a"""
check("skill_residual_model", "SELECT jobs, r2 FROM effects_r2", "r2")
check("salary_two_stage", f"""SELECT 'baseline_r2' AS part, CAST(NULL AS VARCHAR) AS skill, CAST(NULL AS VARCHAR) AS other,
        1 - sum(residual * residual) / (var_pop(salary) * count(*)) AS value FROM residuals
    UNION ALL SELECT 'skill_r2', NULL, NULL, r2 FROM effects_r2
    UNION ALL SELECT 'skill_premiums', skill, NULL, dollar_premium FROM premiums
    UNION ALL SELECT 'skill_interactions', skill_1, skill_2, synergy FROM ({_INTERACTIONS})""", "value")

# The greedy walk over ranked skills: each free one takes up to four free partners.
PARTS["cluster_top"] = """SELECT skill, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, skill) AS rk
    FROM skill_rows GROUP BY skill QUALIFY rk <= 30"""
PARTS["cluster_edges"] = """SELECT p.skill AS a, q.skill AS b, count(*) AS n
    FROM skill_rows p JOIN skill_rows q ON p.job_id = q.job_id AND p.skill <> q.skill
    JOIN cluster_top s ON s.skill = p.skill JOIN cluster_top t ON t.skill = q.skill
    GROUP BY ALL HAVING count(*) >= 10"""
PARTS["cluster_list"] = "SELECT coalesce(list({'a': a, 'b': b, 'n': n}), []) AS edges FROM cluster_edges"
PARTS["cluster_walk"] = """SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS used,
        CAST(NULL AS VARCHAR) AS core, CAST([] AS STRUCT(m BIGINT, p VARCHAR)[]) AS chosen
    UNION ALL
    SELECT step + 1, CASE WHEN takes THEN list_concat(used, list_concat([name], list_transform(pick, lambda c: c.p)))
        ELSE used END, CASE WHEN takes THEN name END, pick
    FROM (SELECT *, NOT list_contains(used, name) AND len(pick) > 0 AS takes FROM (
        SELECT w.step, w.used, t.skill AS name, list_slice(list_sort(list_transform(
            list_filter(e.edges, lambda x: x.a = t.skill AND NOT list_contains(w.used, x.b)),
            lambda x: {'m': -x.n, 'p': x.b})), 1, 4) AS pick
        FROM cluster_walk w JOIN cluster_top t ON t.rk = w.step + 1, cluster_list e))"""
_CLUSTERS = """SELECT 'Cluster_' || row_number() OVER (ORDER BY step) AS cluster, core AS core_skill,
    array_to_string(list_concat([core], list_transform(chosen, lambda c: c.p)), '|') AS skills,
    -CAST(list_sum(list_transform(chosen, lambda c: c.m)) AS DOUBLE) / len(chosen) AS avg_co_occurrence,
    CAST(len(chosen) + 1 AS INTEGER) AS size FROM cluster_walk WHERE core IS NOT NULL"""
check("skill_clusters", _CLUSTERS, "avg_co_occurrence")
check("skill_ecosystem", f"""SELECT 'top_combinations' AS part, skill_1 AS key, skill_2 AS item,
        CAST(mentions AS DOUBLE) AS value FROM ({prevalent_pairs(15)})
    UNION ALL SELECT 'natural_clusters', core_skill, skills, avg_co_occurrence FROM ({_CLUSTERS})
    UNION ALL SELECT 'role_specializations', standardized_title, top_skills, skill_intensity FROM ({_ROLES})
    UNION ALL SELECT 'skill_universality', kind, skill, avg_prevalence FROM ({_UNIVERSAL})""", "value")

# A saved pivot, read back and filtered: only the rows that are left count.
def among(rows: str) -> str:
    return f"(SELECT * FROM skill_rows WHERE {rows})"


_SAVED = among("""published BETWEEN '1996_01' AND '1999_06' AND standardized_title = 'Data Engineer'
    AND skill IN ('python', 'tableau')""")
check("filtered_pivot_frequency", f"""SELECT skill, mentions, total_jobs, mentions / total_jobs * 100 AS prevalence
    FROM (SELECT skill, count(DISTINCT job_id) AS mentions FROM {_SAVED} GROUP BY skill),
        (SELECT count(DISTINCT job_id) AS total_jobs FROM {_SAVED})
    ORDER BY mentions DESC, skill LIMIT 20""", "prevalence")
_SAVED = among("""published BETWEEN '1993_03' AND '1998_01' AND skill IN ('python', 'sql', 'aws', 'excel')""")
check("filtered_pivot_roles", f"""SELECT standardized_title, skill, mentions, total_jobs,
    mentions / total_jobs * 100 AS prevalence,
    CAST(row_number() OVER (PARTITION BY standardized_title ORDER BY mentions DESC, skill) AS INTEGER) AS rank
    FROM (SELECT standardized_title, skill, count(DISTINCT job_id) AS mentions FROM {_SAVED} GROUP BY ALL)
    JOIN (SELECT standardized_title, count(DISTINCT job_id) AS total_jobs FROM {_SAVED} GROUP BY ALL)
        USING (standardized_title) QUALIFY rank <= 3""", "prevalence")

# Quality and cleaning --------------------------------------------------------------

check("quality_report", """SELECT count(*) AS total_jobs,
    count(*) FILTER (slug IS NULL OR trim(slug) = '') AS missing_job_slug,
    count(*) FILTER (title IS NULL OR trim(title) = '') AS missing_title,
    count(*) FILTER (company_slug IS NULL OR trim(company_slug) = '') AS missing_company,
    count(*) FILTER (country IS NULL OR trim(country) = '') AS missing_country,
    count(*) FILTER (published IS NULL) AS missing_dates,
    count(*) FILTER (salary_min < 0 OR salary_max < 0 OR salary_min > salary_max) AS invalid_salaries,
    count(*) FILTER (published > TIMESTAMP '2001-01-01') AS future_dates FROM raw_jobs""")
check("duplicate_keys", """SELECT count(*) AS duplicate_keys FROM (SELECT l_orderkey FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
_PROFILE = ("job_id", "published", "country", "company_name", "job_type", "work_mode",
            "standardized_title", "seniority_level", "skills", "salary_min", "salary_max")
check("missing_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing,
    (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM analysis_jobs""" for c in _PROFILE)
    + ") WHERE missing > 0", "missing_pct")
check("clean_jobs", f"""SELECT j.job_slug, j.title,
    array_to_string(list_filter(j.skills, lambda s: s NOT IN ({_GENERIC})), '|') AS skills,
    array_to_string(types, '|') AS types, k.country, j.city, j.salary_min, j.salary_max, j.salary_currency,
    j.salary_period, strftime(j.published, '%Y_%m') AS published, company_name, company_sector,
    j.country_original, salary_min_annual_usd, salary_max_annual_usd, salary_annual_usd,
    {_SENIORITY.replace('title', 'j.title')} AS seniority_level, {_JOB_TYPE} AS job_type, {_WORK_MODE} AS work_mode,
    CAST(coalesce(len(list_filter(j.skills, lambda s: s NOT IN ({_GENERIC}))), 0) AS INTEGER) AS skills_count
    FROM (SELECT * REPLACE (c.country AS country), country_original FROM ctas JOIN
            (SELECT slug, country, country_original FROM clean_countries) c ON c.slug = job_slug
        QUALIFY row_number() OVER (PARTITION BY title, c.country, skills, salary_min, salary_max
            ORDER BY published ASC NULLS LAST, job_slug) = 1) j
    JOIN clean_countries k ON k.slug = job_slug
    JOIN (SELECT slug, salary_min_annual_usd, salary_max_annual_usd, salary_annual_usd FROM annual_jobs) u
    ON u.slug = job_slug""")

# Streams: the final state -----------------------------------------------------------

check("stream_company_counts", """SELECT user_id AS company_slug,
    CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS jobs_count,
    CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'view' THEN 1 WHEN 'click' THEN -1
        ELSE 0 END) AS BIGINT) AS jobs_ai_count FROM events GROUP BY user_id""")
check("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
check("stream_session_first", """SELECT user_id, event_type, event_id FROM (SELECT *,
    ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS since FROM events)
    WHERE since IS NULL OR since > INTERVAL 1 DAY""")
check("stream_batch_upsert", """SELECT user_id, event_type, min(event_id) AS event_id FROM events
    GROUP BY user_id, event_type""")
check("stamp_updated_at", """SELECT company_key, source_key, amount, created_at_utc, updated_at_utc FROM (
    SELECT c_custkey AS company_key, CAST(NULL AS BIGINT) AS source_key, c_acctbal AS amount,
        TIMESTAMP '2020-01-01' AS created_at_utc, TIMESTAMP '2020-01-01' AS updated_at_utc FROM customer
    WHERE c_acctbal >= 0 AND c_custkey NOT IN (SELECT company_key FROM latest_orders)
    UNION ALL SELECT l.*, CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-05-01' END,
        TIMESTAMP '2024-05-01' FROM latest_orders l JOIN customer ON c_custkey = company_key)""", "amount")