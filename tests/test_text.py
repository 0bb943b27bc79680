from pyspark.sql import functions as F

from talentgrid.functions import dates, skills, text
from talentgrid.plans import cleaning, projection


def mapped(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()]


def test_countries(spark):
    cases = {
        None: "Unknown", "Unknown": "Unknown", "US": "United States", "FR": "France",
        "JP": "Japan", "Some Unknown Country": "Some Unknown Country", "IN": "United States",
        "CA": "United States", "DE": "United States", "Germany": "Germany",
        "Rio de Janeiro": "United States", "Belgium; France": "France",
        "US: Remote": "United States", "guinea-bissau": "Guinea-Bissau", "[ ]": "Unknown",
        "  ": "Unknown", "Peru: Lima": "Peru", "Peru; Lima": "Peru", "u. s. a": "United States",
        "Bosnia": "Bosnia And Herzegovina", "Republic of KOREA": "South Korea",
        "Belarus": "Belarus", "Latin  America": "Latin America",
    }
    assert mapped(spark, list(cases), text.standardize_country) == list(cases.values())


def test_job_type_and_mode(spark):
    cases = [
        ("vollzeit", "full_time", None), ("deeltijds", "part_time", None),
        ("stage", "internship", None), ("remoto", None, "remote"), ("unknown_type", None, None),
        ("全职", None, None), ("fte or 1099", None, None),
        ("Full-time Internship, Remote", "internship", "remote"),
        ("Hybrid contract, remote", "contract", "remote"), ("on-site", None, "onsite"), (None, None, None),
    ]
    values = [c[0] for c in cases]
    assert mapped(spark, values, text.job_type) == [c[1] for c in cases]
    assert mapped(spark, values, text.work_mode) == [c[2] for c in cases]


def test_only_first_employment_type_counts(spark):
    lists = [["Contract", "Remote"], [], None]
    kinds = mapped(
        spark, lists, lambda v: text.job_type(text.employment_text_of(v)), "array<string>"
    )
    modes = mapped(
        spark, lists, lambda v: text.work_mode(text.employment_text_of(v)), "array<string>"
    )
    assert kinds == ["contract", None, None] and modes == [None, None, None]


def test_seniority(spark):
    cases = {
        "Senior Data Scientist": "Senior", "Lead AI Engineer": "Lead",
        "Intern Data Analyst": "Intern", "Data Engineer": "Unspecified", None: "Unknown",
        " ": "Unknown", "Jr. Analyst": "Junior", "Entry Level Dev": "Junior",
        "Mid-level Dev": "Mid-level", "Head of Data": "Manager", "Chief Data Officer": "Executive",
        "Senior Manager": "Senior", "International Analyst": "Unspecified",
        "élead": "Unspecified",
    }
    assert mapped(spark, list(cases), text.extract_seniority) == list(cases.values())


def test_skill_texts(spark):
    cases = {
        "['python', 'sql', 'tensorflow']": ["python", "sql", "tensorflow"],
        '["python", "machine learning"]': ["python", "machine learning"],
        "python,sql,r": ["python", "sql", "r"], "python, sql, r": ["python", "sql", "r"],
        None: [], "": [], "   ": [], "[]": [], "['']": [""],
        "['python, 'sql": ["['python", "'sql"],
    }
    assert mapped(spark, list(cases), skills.parse_skill_list) == list(cases.values())
    assert mapped(spark, ["a, ,b,", None, ""], skills.split_csv) == [["a", "b"], [], []]


def test_skill_arrays(spark):
    lists = [["Python", " python", "SQL\t", "", None], ["AI", "Spark", "AI", "Spark"], [], None]
    normal = mapped(spark, lists, skills.normalize_skills, "array<string>")
    assert normal == [["python", "sql"], ["ai", "spark"], [], None]
    kept = mapped(spark, lists, skills.remove_generic_skills, "array<string>")
    assert kept[1:] == [["Spark", "Spark"], [], None]
    assert mapped(spark, lists, skills.skills_count, "array<string>") == [5, 4, 0, 0]


def test_dates(spark):
    values = ["invalid_date", "2023-13-01", None, "2023-01-01"]
    assert mapped(spark, values, lambda v: dates.year_month_of(v)[0]) == [None, None, None, 2023]
    moments = mapped(spark, ["0001-01-01T00:00:00Z", "2024-02-03T04:05:06Z", "soon", None],
                     dates.parse_moment)
    assert [m is None for m in moments] == [True, False, True, True]
    months = mapped(spark, ["2024_01", "2024_03", "2024_04"],
                    lambda v: dates.month_between(v, "2024-01-01", "2024-03-01"))
    assert months == [True, True, False]
    late = mapped(spark, ["2024_01", "2024_02", "2025_01", None],
                  lambda v: dates.month_between(v, "2024-01-02", "2024-12-31"))
    assert late == [False, True, False, None]


def test_long_urls_stay_whole(spark, tmp_path):
    url = "http://example.com/" + "x" * 3000
    spark.createDataFrame([(1, url, "")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "pages.parquet")
    )
    row = projection.url_results(spark, str(tmp_path)).first()
    assert row["final_url"] == "greenhouse.io/" + "x" * 3000


def test_urls(spark):
    cases = {
        "https://boards.greenhouse.io/x": "greenhouse", "http://jobs.Lever.co/a": "lever",
        "https://x.myworkdayjobs.com/": "workday", "ftp://host/a": "web", "no-scheme.org": "invalid",
        "https:///path": "invalid", None: "invalid", "": "invalid", "http://[::1/x": "invalid",
    }
    assert mapped(spark, list(cases), text.url_type) == list(cases.values())
    bare = "https://go.example/r/"
    assert mapped(spark, [bare, bare + "1"], lambda v: text.url_is_valid(v, bare)) == [False, True]


def test_locations(spark):
    df = spark.createDataFrame(
        [("", "Paris", "France"), ("Here", "Paris", "France"), (None, "", "France"),
         (None, "Paris", None), (None, None, None)], "l string, c string, n string")
    got = [r[0] for r in df.select(text.compose_location(F.col("l"), F.col("c"), F.col("n"))).collect()]
    assert got == ["Paris, France", "Here", "France", "Paris", ""]


def test_employment_as_plain_text(spark):
    listed = spark.createDataFrame([(["Full-time, Remote"],), (None,)], "types array<string>")
    plain = spark.createDataFrame([("Full-time, Remote",), (None,)], "types string")
    kinds = [[(r["job_type"], r["work_mode"]) for r in cleaning.clean_employment(d).collect()] for d in (listed, plain)]
    assert kinds[0] == kinds[1]
