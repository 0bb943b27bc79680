"""Declared schemas of the tables and payloads read."""

from __future__ import annotations

_JOB_TEXT = (
    "roles string, seniority string, city string, country string, location string"
)

COMPANIES = (
    "slug string, name string, description string, description_gpt string, "
    "description_premium string, description_linkedin string, description_combined_gpt string, "
    "description_perplexity string, logo string, url string, city string, country string, "
    "areas string, size_min int, size_max int, year_founded int, glassdoor_score decimal(3,1), "
    "linkedin_staff_count int, linkedin_follower_count int, twitter string, linkedin string, "
    "facebook string, instagram string, github string, crunchbase string, angel_list string, "
    "stack_overflow string, behance string, dribbble string, product_hunt string, "
    "public_vs_private string, company_sector string, linkedin_tags string, "
    "key_products string, using_ai string, ai_products_gpt string, mission_values string, "
    "jobs_count int, jobs_ai_count int, last_job_source string"
)

JOBS = (
    "slug string, company_slug string, title string, description string, premium boolean, "
    "ai boolean, status int, created_at timestamp, published timestamp, pin_until timestamp, "
    "skills array<string>, soft_skills array<string>, tools array<string>, "
    "languages array<string>, frameworks array<string>, libraries array<string>, "
    f"types array<string>, {_JOB_TEXT}, salary_min int, salary_max int, "
    "salary_currency string, salary_period string, benefits string, beneficial string, "
    "experience string, ideal_candidate string, qualifications string, schema string, "
    "force_status string, same_as int"
)

JOB_SKILLS = "job_slug string, skill_name string, skill_category string"

EXCHANGE_RATES = (
    "currency_code string, rate_to_usd decimal(12,6), effective_date date, created_at timestamp"
)

# A posting as the first source's payload spells it: lists are comma text, dates are text.
PAYLOAD_JOB = (
    "slug string, title string, description string, premium boolean, ai boolean, status int, "
    "created_at string, published string, pin_until string, skills string, soft_skills string, "
    "tools string, languages string, frameworks string, libraries string, type string, "
    f"{_JOB_TEXT}, salary_min int, salary_max int, salary_currency string, "
    "salary_period string, benefits string, beneficial string, experience string, "
    "ideal_candidate string, qualifications string, schema string, force_status string, "
    "same_as int"
)

PAYLOAD = (
    f"array<struct<job: struct<{PAYLOAD_JOB.replace(' ', ': ').replace(',: ', ', ')}>, "
    f"company: struct<{COMPANIES.replace(' ', ': ').replace(',: ', ', ')}>, "
    "location: string, types: array<string>>>"
)

# The second source: one object per posting with nested company, types, countries, cities.
STAR_POSTING = (
    "struct<id: bigint, ext_id: string, "
    "company: struct<id: bigint, source_id: bigint, name: string, logo: string, "
    "website_url: string, linkedin_url: string, twitter_handle: string, github_url: string, "
    "is_agency: boolean>, "
    "title: string, location: string, description: string, experience_level: string, "
    "application_url: string, language: string, has_remote: boolean, published: string, "
    "salary_min: int, salary_max: int, salary_currency: string, "
    "types: array<struct<id: bigint, name: string>>, "
    "countries: array<struct<id: bigint, code: string, name: string, "
    "region: struct<id: bigint, name: string>>>, "
    "cities: array<struct<geonameid: bigint, asciiname: string, name: string, "
    "country: struct<code: string>, state: struct<code: string>, timezone: string, "
    "latitude: decimal(10,8), longitude: decimal(11,8), population: bigint>>>"
)

CLEANED_CSV = (
    "job_slug string, title string, skills string, country string, published string, "
    "company_name string, salary_min int, salary_max int, job_type string, work_mode string, "
    "standardized_title string, seniority_level string"
)

URL_RESULTS = (
    "slug string, final_url string, type string, success boolean, attempts int, "
    "status_code int, error string"
)
