"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from talentgrid.plans.queries import QUERIES
from talentgrid.session import local_session

HEADLINE = [
    "flatten_postings_json", "normalize_star_json", "write_pivot", "insert_ignore",
    "upsert_update", "cleaned_ctas", "facet_filter", "listings_with_company",
    "skill_pair_selfjoin", "skill_pivot", "aggregate_pivot", "skill_frequency",
    "skill_category_frequency", "skill_month_matrix", "facet_values", "overview_metrics",
    "dataset_profile", "dedupe_earliest", "share_in_group", "topn_per_group",
    "distinct_rows", "standardize_country", "salary_annual_usd", "job_type_mode",
    "extract_seniority", "parse_skill_list", "unpivot_skill_arrays", "ewma", "skill_trends",
    "process_trends", "trend_insights", "skill_pairs", "pair_prevalence", "skill_clusters",
    "universal_specialized", "skills_by_role", "skills_by_seniority", "skills_by_country",
    "role_comparison", "skill_progression", "seniority_patterns", "level_specific_skills",
    "skill_diversity", "nearest_category", "similarity_matrix", "salary_baseline_residual",
    "skill_premium", "skill_interactions", "quality_report", "missing_profile", "clean_jobs",
    "stream_company_counts", "stream_batch_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["skills_by_role"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
