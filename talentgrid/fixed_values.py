"""Lists, tables and labels that decide the results.

Nothing here is tuned or derived; changing an entry changes what the operators
answer. Each block is in its natural order (rule order where order matters).
"""

from __future__ import annotations

# Skill -> category, lower-cased skill names.
SKILL_CATEGORIES = {
    "Programming": ["python", "r", "sql", "java", "scala", "c++", "javascript", "julia"],
    "ML Frameworks": ["tensorflow", "pytorch", "keras", "scikit-learn", "mxnet", "caffe"],
    "Big Data": ["spark", "hadoop", "hive", "kafka", "airflow", "dbt", "snowflake"],
    "Cloud": ["aws", "azure", "gcp", "docker", "kubernetes", "terraform"],
    "Visualization": ["tableau", "powerbi", "matplotlib", "seaborn", "plotly", "d3"],
    "Statistics": ["statistics", "hypothesis testing", "experimentation", "a/b testing"],
    "ML Techniques": [
        "machine learning", "deep learning", "nlp", "computer vision", "reinforcement learning",
    ],
}

# Seniority levels, lowest first.
SENIORITY_ORDER = [
    "Unspecified", "Intern", "Junior", "Mid-level", "Senior", "Lead", "Manager", "Executive",
]

# Levels shown in progression charts, lowest first.
PROGRESSION_LEVELS = ["Entry-level", "Junior", "Mid-level", "Senior", "Lead", "Executive"]

# Role names a title can be standardized to.
ROLE_NAMES = [
    "Data Scientist", "Machine Learning Engineer", "AI Engineer", "Data Analyst",
    "Data Engineer", "MLOps Engineer", "Data Architect", "Analytics Engineer",
    "Research Scientist", "Data Science Manager", "AI Researcher", "Product Data Scientist",
]

# Skills too generic to count, exact case.
GENERIC_SKILLS = [
    "Data Science", "Artificial Intelligence", "AI", "Analytics", "Data Analysis",
    "Programming", "Coding", "Statistics", "ML", "Machine Learning", "Data Engineer",
    "Data Engineering", "Data", "Science", "Business Intelligence", "BI",
    "Computer Science", "CS", "IT", "Information Technology", "Software Development",
    "Development", "Engineering", "Research", "R&D",
]

# The pattern that marks free-text United States spellings (lower-cased text).
UNITED_STATES_PATTERN = (
    r"(^|[^a-z])(usa|u[\s.]*s[\s.]*a|u[\s.]*s|united\s+states"
    r"|united\s+states\s+of\s+america)([^a-z]|$)"
)

# Whole-word country rules, first match wins, case ignored.
COUNTRY_RULES = [
    ("United States",
     "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH"
     "|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WV|WI|WY|DC"),
    ("United Kingdom", r"UK|United\s+Kingdom|England"),
    ("France", "FR|FRANCE"),
    ("South Africa", r"ZA|SOUTH\s+AFRICA"),
    ("Cyprus", "CY|CYPRUS"),
    ("Ukraine", "UA|UKRAINE"),
    ("Italy", "IT|ITALY"),
    ("Morocco", "MAROC|MOROCCO"),
    ("Czech Republic", r"CZECHIA|CZECH\s+REPUBLIC"),
    ("Bosnia and Herzegovina", r"BOSNIA|BOSNIA\s+AND\s+HERZEGOVINA"),
    ("South Korea", r"KOREA|SOUTH\s+KOREA|KOREA,\s+REPUBLIC\s+OF"),
    ("Turkey", "TURKIYE|TURKEY|TR"),
    ("Tunisia", "TUNISIE|TUNISIA"),
    ("Brazil", "BRASIL|BRAZIL|BR"),
    ("Japan", "JP|JAPAN"),
    ("Uruguay", "UY|URUGUAY"),
    ("Philippines", "PH|PHILIPPINES"),
    ("Singapore", "SG|SINGAPORE"),
    ("Netherlands", r"NL|NETHERLANDS|THE\s+NETHERLANDS"),
    ("Sweden", "SE|SWEDEN"),
    ("Switzerland", "CH|SWITZERLAND"),
    ("Greece", "GR|GREECE"),
    ("India", "IN|INDIA"),
    ("Portugal", "PT|PORTUGAL"),
    ("Australia", "AU|AUSTRALIA"),
    ("New Zealand", r"NZ|NEW\s+ZEALAND"),
    ("Belgium", "BE|BELGIUM"),
    ("Mexico", "MX|MEXICO"),
    ("Russia", "RU|RUSSIA"),
    ("Egypt", "EG|EGYPT"),
    ("Finland", "FI|FINLAND"),
    ("Saudi Arabia", r"SA|SAUDI\s+ARABIA"),
    ("Ireland", "IE|IRELAND"),
    ("Germany", "DE|GERMANY"),
    ("Spain", "ES|SPAIN"),
    ("China", "CN|CHINA"),
    ("Canada", "CA|CANADA"),
    ("United Arab Emirates", r"UAE|UNITED\s+ARAB\s+EMIRATES"),
    ("Europe", "EUROPE"),
    ("North America", r"NORTH\s+AMERICA"),
    ("Latin America", r"LATIN\s+AMERICA"),
]

# Currency -> USD per unit.
USD_PER_UNIT = {
    "USD": "1.0", "EUR": "1.10", "GBP": "1.27", "CAD": "0.75", "AUD": "0.67",
    "JPY": "0.0075", "CNY": "0.14", "INR": "0.012", "PLN": "0.25", "SEK": "0.095",
    "DKK": "0.15", "CHF": "1.12", "BRL": "0.20", "MXN": "0.055", "TWD": "0.033",
    "KRW": "0.00075", "VND": "0.000043", "AED": "0.27", "PHP": "0.018", "RUB": "0.011",
    "SGD": "0.74", "THB": "0.028", "IDR": "0.000065", "MYR": "0.21", "ZAR": "0.054",
    "NZD": "0.62", "NOK": "0.095", "CZK": "0.045", "HUF": "0.0028", "RON": "0.22",
    "TRY": "0.031", "ILS": "0.27", "SAR": "0.27", "QAR": "0.27", "KWD": "3.25",
    "OMR": "2.60", "BDT": "0.0091", "PKR": "0.0036", "LKR": "0.0033", "EGP": "0.021",
    "NGN": "0.00066", "KES": "0.0068", "COP": "0.00024", "ARS": "0.0012", "CLP": "0.0011",
    "PEN": "0.27", "VES": "0.0000014",
}

# Pay period spellings (lower case) -> periods per year.
PERIODS_PER_YEAR = [
    (("hour", "hourly", "/hour", "per hour", "hr", "/hr"), 2080),
    (("day", "daily", "/day", "per day"), 260),
    (("week", "weekly", "/week", "per week"), 52),
    (("month", "monthly", "/month", "per month"), 12),
]

# Employment terms, groups in matching order.
INTERNSHIP_TERMS = [
    "internship", "intern", "stage", "staż", "stagiair", "praktikant", "stagista", "co-op",
    "co op", "graduate", "industrial placement", "binance accelerator program",
    "apprenticeship", "thesis", "training",
]
JOB_TYPE_TERMS = [
    ("full_time", [
        "full-time", "full time", "permanent", "regular", "employee", "voltijds", "vollzeit",
        "heltid", "a jornada completa", "fulltid", "fuldtid", "pełny etat",
        "полная занятость", "全职", "período integral", "cdi", "cdi cadre",
    ]),
    ("part_time", [
        "part-time", "part time", "teilzeit", "deeltijds", "meio período",
        "частичная занятость", "working student",
    ]),
    ("contract", [
        "contract", "freelance", "temporary", "fixed term", "consultant", "contrat",
        "contrato", "werkvertrag", "project based", "fellowship", "billable",
        "fte or 1099", "limited", "cdd",
    ]),
]
WORK_MODE_TERMS = [
    ("remote", ["remote", "remoto", "remoto primeiro", "full remoto"]),
    ("hybrid", ["hybrid"]),
    ("onsite", [
        "in-office", "in office", "in-person", "office-based", "on-site", "onsite", "onroll",
        "on-roll", "on-rolls",
    ]),
]

# Seniority patterns on titles, first match wins.
SENIORITY_PATTERNS = [
    ("Intern", r"intern|internship|trainee|apprentice|student"),
    ("Junior", r"entry[-\s]?level|junior|jr\.?"),
    ("Mid-level", r"associate|mid[-\s]?level|intermediate"),
    ("Senior", r"senior|sr\.?"),
    ("Lead", r"lead|principal|specialist|staff"),
    ("Manager", r"manager|head|director|supervisor"),
    ("Executive", r"vice president|vp|chief|executive|cto|ceo|founder|co-founder"),
]

# URL type -> text looked for in the lower-cased URL, first match wins.
URL_TYPE_MARKS = [
    ("api", "dejobs.org"), ("greenhouse", "greenhouse.io"), ("lever", "lever.co"),
    ("workday", "workday"), ("icims", "icims.com"), ("jobvite", "jobvite.com"),
    ("taleo", "taleo"),
]

# Trend labels by category number.
TREND_LABELS = [
    "Hot & Growing", "Stable & In-Demand", "Niche & Specialized", "Declining & Risky",
    "Emerging & New",
]

# What stands in for a missing dimension.
DIMENSION_DEFAULTS = {
    "seniority_level": "Unspecified",
    "job_type": "Unspecified",
    "work_mode": "Unspecified",
    "country": "Unknown",
    "company_name": "Unknown",
    "standardized_title": "Unknown",
}

# Date text that means "no date", title match threshold, no-match role.
EMPTY_DATE_TEXT = "0001-01-01T00:00:00Z"
TITLE_MATCH_THRESHOLD = 0.47
NO_ROLE = "Other"
