"""Core model and sector, salary, skill and coverage benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    ENTERPRISE_ABOVE, canonicalize_pay, days_open, rounded, share, stage_dim,
)
from ..operators.relational import dedupe_best, min_sample

# Pay bands and sample floors of the published benchmarks.
PAY_BAND = (50_000, 500_000)
BENCHMARK_BAND = (30_000, 500_000)


def in_band(pay: Column, band: tuple[int, int] = PAY_BAND) -> Column:
    """Pay inside the band, else null.

    The bands bound how many distinct whole amounts an exact percentile can hold
    in its buffer, whatever the size of the group.
    """
    return F.when(pay.between(*band), pay)


def median(value: Column, digits: int = 0, p: float = 0.5) -> Column:
    return rounded(F.percentile(value, p), digits)


def stage_job_skills(job_skills: DataFrame) -> DataFrame:
    best = dedupe_best(job_skills, ["job_id", "skill_id"],
                       [F.col("confidence").desc_nulls_last(), F.col("job_skills_id")])
    return best.withColumn("skill_priority", F.lower("skill_priority"))


def bridge_job_skills(job_skills: DataFrame, skills: DataFrame) -> DataFrame:
    return stage_job_skills(job_skills).join(skills.select("skill_id", "skill_name", "difficulty_relevant", "group_id"), "skill_id")


def fct_jobs(postings: DataFrame, honesty: DataFrame, as_of: str) -> DataFrame:
    jobs = days_open(canonicalize_pay(postings), as_of)
    return jobs.join(honesty.select("job_id", "honesty_score"), "job_id", "left")


def dim_companies(companies: DataFrame, postings: DataFrame, discovered: DataFrame, headcount: DataFrame) -> DataFrame:
    """Company dimension; sector and head count are matched on the lower-cased name."""
    sectors = discovered.groupBy(F.lower("company_name").alias("name_key")).agg(F.max("sector").alias("found_sector"))
    heads = headcount.groupBy(F.lower("company_name").alias("name_key")).agg(F.max("employee_count").alias("employee_count"))
    active = (
        postings.filter((F.col("status") == "raw") & (F.col("data_tier") == 1))
        .groupBy("company_id").agg(F.count(F.lit(1)).alias("active_roles"))
    )
    staged = stage_dim(companies.drop("employee_count"), ["company_name", "company_type"]).withColumn("name_key", F.lower("company_name"))
    wide = staged.join(sectors, "name_key", "left").join(heads, "name_key", "left").join(active, "company_id", "left")
    staff, roles = F.col("employee_count"), F.coalesce("active_roles", F.lit(0))
    hiring = (staff > 0) & (roles > 0)
    return wide.select(
        "company_id", "company_name", "company_type",
        F.coalesce("sector", "found_sector").alias("sector"),
        roles.alias("active_roles"), "employee_count",
        F.when(staff <= ENTERPRISE_ABOVE, "growth").when(staff > ENTERPRISE_ABOVE, "enterprise").alias("company_tier"),
        F.when(hiring, rounded(roles / staff * 100, 2)).alias("hiring_intensity_pct"),
        F.when(hiring, rounded(roles / staff * 1000, 2)).alias("hiring_intensity_per_1k"),
        F.when(staff <= ENTERPRISE_ABOVE, "per 100 employees").when(staff > ENTERPRISE_ABOVE, "per 1,000 employees").alias("intensity_label"),
    )


def _usable(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.coalesce("data_quality", F.lit("ok")) == "ok")


def skill_demand(jobs: DataFrame, bridge: DataFrame, floor: int = 5) -> DataFrame:
    """Unpriced postings are dropped before counting."""
    priced = _usable(jobs).filter((F.col("data_tier") == 1) & F.col("salary_max_annual").isNotNull())
    pairs = bridge.select("job_id", "skill_name").join(
        priced.select("job_id", "experience_level", "workplace_type", "salary_max_annual"), "job_id")
    out = pairs.groupBy("experience_level", "workplace_type", "skill_name").agg(
        F.countDistinct("job_id").alias("jobs_with_skill"), median(F.col("salary_max_annual")).alias("median_salary"))
    return min_sample(out, floor, "jobs_with_skill")


def salary_benchmarks(jobs: DataFrame, floor: int = 3) -> DataFrame:
    top, low = F.col("salary_max_annual"), F.col("salary_min_annual")
    priced = _usable(jobs).filter(top.between(*BENCHMARK_BAND) & F.col("data_tier").isin(1, 2))
    out = priced.groupBy("data_tier", "ingestion_source", "experience_level", "workplace_type", F.col("loc_state").alias("state")).agg(
        F.countDistinct("job_id").alias("job_count"),
        rounded(F.avg(low), 0).alias("avg_salary_min"), rounded(F.avg(top), 0).alias("avg_salary_max"),
        median(top, p=0.25).alias("p25_salary"), median(top).alias("median_salary"), median(top, p=0.75).alias("p75_salary"),
    )
    return min_sample(out, floor, "job_count")


def market_coverage(jobs: DataFrame) -> DataFrame:
    priced = F.when(F.col("salary_max_annual").isNotNull(), F.col("job_id"))
    return (
        _usable(jobs).filter(F.col("data_tier").isin(1, 2))
        .groupBy(F.date_trunc("month", "ingested_at").cast("date").alias("month_start"),
                 "data_tier", "ingestion_source", "experience_level", "workplace_type")
        .agg(F.countDistinct("job_id").alias("job_count"), F.countDistinct(priced).alias("jobs_with_salary"),
             median(F.col("salary_max_annual")).alias("median_salary"))
        .withColumn("salary_disclosure_pct", rounded(F.col("jobs_with_salary") * 100.0 / F.col("job_count"), 1))
    )


def sector_benchmarks(jobs: DataFrame, companies: DataFrame, risk: DataFrame, as_of: str, floor: int = 10) -> DataFrame:
    """One row per sector, with a true percentage and active-only remote share."""
    scoped = jobs.filter(F.col("data_tier") == 1).join(
        companies.select("company_id", "sector").filter(F.col("sector").isNotNull()), "company_id")
    active = F.col("status") == "raw"
    top = F.col("salary_max_annual")
    base = scoped.groupBy("sector").agg(
        F.countDistinct(F.when(active, F.col("job_id"))).alias("active_roles"),
        F.countDistinct("job_id").alias("total_roles"),
        F.countDistinct(F.when(active & (F.col("workplace_type") == "remote"), F.col("job_id"))).alias("remote_roles"),
        share(top.isNotNull()).alias("transparency_pct"),
        rounded(F.avg("honesty_score"), 1).alias("avg_honesty_score"),
        median(F.when(active, in_band(top))).alias("median_max_salary"),
        rounded(F.avg(in_band(top)), 0).alias("avg_max_salary"),
        rounded(F.avg(F.when(active, F.datediff(F.lit(as_of).cast("date"), "posted_date"))), 0).alias("avg_days_open"),
    )
    ghosts = risk.filter(F.col("sector").isNotNull()).groupBy("sector").agg(
        rounded(F.avg("ghost_probability"), 1).alias("avg_ghost_prob"),
        share(F.col("ghost_tier").isin("high", "medium")).alias("pct_likely_ghost"))
    out = base.join(ghosts, "sector", "left").withColumns({
        "pct_still_active": rounded(F.col("active_roles") * 100.0 / F.col("total_roles"), 1),
        "pct_remote": rounded(F.col("remote_roles") * 100.0 / F.nullif(F.col("active_roles"), F.lit(0)), 1),
    })
    return min_sample(out, floor, "total_roles").drop("remote_roles")


def honesty_by_company(honesty: DataFrame, jobs: DataFrame, companies: DataFrame, floor: int = 3) -> DataFrame:
    score = F.col("honesty_score")
    scored = honesty.select("job_id", "honesty_score").join(
        jobs.filter((F.col("data_tier") == 1) & (F.col("status") == "raw")).select("job_id", "company_id", "salary_max_annual"), "job_id"
    ).join(companies.filter(F.col("sector").isNotNull()).select("company_id", "company_name", "sector"), "company_id")
    out = scored.groupBy("company_id", "company_name", "sector").agg(
        F.countDistinct("job_id").alias("scored_jobs"), rounded(F.avg(score), 1).alias("avg_honesty_score"),
        F.min(score).cast("double").alias("min_honesty_score"), F.max(score).cast("double").alias("max_honesty_score"),
        median(score, 1).alias("median_honesty_score"), share(F.col("salary_max_annual").isNotNull()).alias("transparency_pct"),
        F.count_if(score >= 90).alias("high_honesty_jobs"), F.count_if(score < 70).alias("low_honesty_jobs"),
    )
    return min_sample(out, floor, "scored_jobs")


def honesty_latest(postings: DataFrame, companies: DataFrame, roles: DataFrame, honesty: DataFrame) -> DataFrame:
    return (
        postings.select("job_id", "company_id", "role_id", "workplace_type", "experience_level", "salary_min",
                        "salary_max", "salary_period", "posted_date", "job_url")
        .join(companies.select("company_id", "company_name"), "company_id", "left")
        .join(roles, "role_id", "left").join(honesty, "job_id", "left").drop("company_id", "role_id")
    )
