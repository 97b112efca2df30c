"""Inputs several queries share, on both the Spark and the checking side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF, Tables
from ..functions.columns import canonicalize_pay, days_open
from ..plans import core, scores
from ..session import cut_lineage

DATES_AFTER = "1990-01-01"  # the test orders are older than the model's own cut-off


# Rules that the checks are run with, written for the fixture's names and titles.
EXCLUSIONS = [("firm 77", "substring"), ("firm 5 inc", "exact"), ("firm 41 ", "substring")]
FAMILIES = [
    ("Leadership", "director|head of|vice president|vp |chief"),
    ("Data Engineer", "data engineer|analytics engineer"),
    ("ML Engineer", "machine learning|ml engineer"),
    ("Data Scientist", "data scientist|data science"),
    ("Analyst", "analyst"),
    ("Operations", "operations"),
]


def jobs(t: Tables) -> DataFrame:
    return days_open(canonicalize_pay(t.postings), AS_OF)


def reposts(t: Tables) -> DataFrame:
    return scores.classify_reposts(t.posting_events, t.postings)


def risk(t: Tables) -> DataFrame:
    return scores.ghost_index(t.postings, t.companies, t.roles, reposts(t), AS_OF, DATES_AFTER)


def fit(t: Tables, postings: DataFrame | None = None) -> DataFrame:
    return scores.plausibility(t.postings if postings is None else postings, t.job_skills, t.skills)


def honesty(t: Tables, postings: DataFrame | None = None) -> DataFrame:
    """Scores of all postings, or of those given: a posting's score depends on no other."""
    return scores.honesty_score(t.texts if postings is None else postings, t.companies, t.roles, fit(t, postings))


def staged(df: DataFrame) -> DataFrame:
    """A mart as a table of its own, for the marts that read it several times or beside others."""
    return cut_lineage(df)


def staged_together(*frames: DataFrame) -> list[DataFrame]:
    """Several marts at once, so that the short stages of one fill the gaps of the others."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(staged, frames))


def dims(t: Tables) -> DataFrame:
    return core.dim_companies(t.companies, t.postings, t.companies.select("company_name", "sector"),
                              t.companies.select("company_name", "employee_count"))


def difficulty(t: Tables) -> DataFrame:
    return scores.hiring_difficulty(jobs(t), t.companies, t.job_skills, t.skills)


# ---- checking-side twins, as CTE lists -------------------------------------------------

PAY = """pay AS (
  SELECT p.*, lower(nullif(trim(salary_period), '')) AS per FROM f_postings p
), jobs AS (
  SELECT *, CASE WHEN per = 'month' THEN 'year' ELSE per END AS pay_period,
    CASE WHEN per = 'month' THEN CASE WHEN salary_min * 12 >= 10000 THEN salary_min * 12 END
         WHEN per = 'hour' THEN salary_min * 2080
         WHEN per = 'year' AND salary_min >= 10000 THEN salary_min END AS salary_min_annual,
    CASE WHEN per = 'month' THEN CASE WHEN salary_max * 12 >= 10000 THEN salary_max * 12 END
         WHEN per = 'hour' THEN salary_max * 2080
         WHEN per = 'year' AND salary_max >= 10000 THEN salary_max END AS salary_max_annual
  FROM pay)"""

REPOSTS = """back AS (
  SELECT e.event_id, e.job_id, e.observed_at, e.posted_date, max(d.observed_at) AS gone_at
  FROM f_posting_events e JOIN f_posting_events d ON d.job_id = e.job_id AND d.event_type = 'disappeared' AND d.observed_at < e.observed_at
  WHERE e.event_type = 'reappeared' GROUP BY ALL
), newer AS (
  SELECT b.*, p.company_id, p.ingestion_source, CAST(b.observed_at AS DATE) AS observed_on,
    epoch_us(b.observed_at) - epoch_us(b.gone_at) AS gap_us
  FROM back b JOIN f_postings p USING (job_id) WHERE b.posted_date > CAST(b.gone_at AS DATE)
), reposts AS (
  SELECT *, count(*) OVER (PARTITION BY company_id, ingestion_source, observed_on, posted_date) AS cohort,
    CAST(floor(gap_us / 86400000000) AS BIGINT) AS gap_days,
    CASE WHEN count(*) OVER (PARTITION BY company_id, ingestion_source, observed_on, posted_date) >= 5 THEN 'bulk_ats_date_refresh'
         WHEN gap_us < 86400000000 THEN 'crawler_churn' ELSE 'individual_repost_signal' END AS signal_class
  FROM newer)"""

RISK = REPOSTS + f""", closures AS (
  SELECT c.sector, p.ingestion_source, (p.last_seen_at - p.posted_date) AS days
  FROM f_postings p LEFT JOIN f_companies c USING (company_id)
  WHERE p.status = 'expired' AND p.expired_reason = 'natural_cron' AND p.posted_date > DATE '{DATES_AFTER}'
    AND (p.last_seen_at - p.posted_date) BETWEEN 3 AND 365
), b2 AS (SELECT sector, ingestion_source, quantile_cont(days, 0.5) AS m, count(*) AS n FROM closures GROUP BY ALL HAVING count(*) >= 20),
b1 AS (SELECT sector, quantile_cont(days, 0.5) AS m, count(*) AS n FROM closures GROUP BY ALL HAVING count(*) >= 20),
b0 AS (SELECT quantile_cont(days, 0.5) AS m, count(*) AS n FROM closures),
sig AS (SELECT job_id, count(*) AS re, max(gap_days) AS longest FROM reposts WHERE signal_class = 'individual_repost_signal' GROUP BY 1),
rel AS (SELECT canonical_opportunity_id, count(DISTINCT job_id) - 1 AS rel, count(DISTINCT ingestion_source) AS srcs FROM f_postings GROUP BY 1),
raw_risk AS (
  SELECT p.job_id, p.company_id, c.company_name, c.sector, ro.role_name, p.ingestion_source, p.posted_date,
    greatest(DATE '{AS_OF}' - p.posted_date, 0) AS days_open_raw, least(greatest(DATE '{AS_OF}' - p.posted_date, 0), 365) AS days_open_capped,
    coalesce(b2.m, b1.m, b0.m) AS base, coalesce(b2.n, b1.n, b0.n, 0) AS baseline_sample_size,
    CASE WHEN b2.m IS NOT NULL THEN 'source_sector' WHEN b1.m IS NOT NULL THEN 'sector' WHEN b0.m IS NOT NULL THEN 'global' END AS baseline_type,
    coalesce(re, 0) AS reappearance_count, longest AS longest_gap_days, coalesce(rel.rel, 0) AS related_posting_count, coalesce(srcs, 0) AS related_source_count
  FROM f_postings p LEFT JOIN f_companies c USING (company_id) LEFT JOIN f_roles ro USING (role_id)
  LEFT JOIN b2 ON b2.sector = c.sector AND b2.ingestion_source = p.ingestion_source LEFT JOIN b1 ON b1.sector = c.sector CROSS JOIN b0
  LEFT JOIN sig ON sig.job_id = p.job_id LEFT JOIN rel ON rel.canonical_opportunity_id = p.canonical_opportunity_id
  WHERE p.data_tier = 1 AND p.status = 'raw' AND p.role_id IS NOT NULL AND coalesce(p.loc_country, 'unknown') IN ('US', 'unknown')
), comp AS (
  SELECT *, CASE WHEN posted_date > DATE '{DATES_AFTER}' AND base IS NOT NULL THEN (1 - 1 / (1 + power(days_open_capped / base, 2))) * 100 END AS age,
    least(reappearance_count * 25.0, 100.0) AS reappearance_risk, least(related_posting_count * 12.5, 100.0) AS repost_risk FROM raw_risk
), risk0 AS (
  SELECT *, CASE WHEN age IS NULL AND reappearance_count = 0 AND related_posting_count = 0 THEN NULL ELSE
    CAST(round(CAST(coalesce(age, 0) * 0.65 + reappearance_risk * 0.20 + repost_risk * 0.15 AS DECIMAL(28,8)), 1) AS DOUBLE) END AS ghost_probability FROM comp
), risk AS (
  SELECT *, CASE WHEN ghost_probability IS NULL THEN 'unscored' WHEN ghost_probability >= 75 THEN 'high' WHEN ghost_probability >= 50 THEN 'medium'
    WHEN ghost_probability >= 25 THEN 'low' ELSE 'fresh' END AS ghost_tier,
    CASE WHEN ghost_probability IS NULL THEN 'low' WHEN baseline_sample_size >= 100 THEN 'high'
      WHEN baseline_sample_size >= 20 OR reappearance_count > 0 OR related_posting_count > 0 THEN 'medium' ELSE 'low' END AS score_confidence
  FROM risk0)"""

BUCKET = """CASE WHEN experience_level = 'entry' THEN 'entry' WHEN experience_level IN ('associate', 'junior') THEN 'associate'
  WHEN experience_level IN ('mid', 'intermediate') THEN 'mid' WHEN experience_level IN ('senior', 'lead', 'principal', 'staff') THEN 'senior' ELSE 'unknown' END"""

FIT = f"""lvl AS (SELECT job_id, {BUCKET} AS level_bucket FROM f_postings),
weights(group_id, lb, w) AS (VALUES ('G1', 'any', 1.2), ('G2', 'any', 0.9), ('G3', 'entry', 1.5), ('G3', 'any', 1.1), ('G5', 'mid', 0.8)),
tagged AS (
  SELECT j.job_id, lower(j.skill_priority) AS pr, s.group_id, coalesce(wl.w, wa.w, 1.0) AS w
  FROM f_job_skills j JOIN lvl USING (job_id) LEFT JOIN f_skills s USING (skill_id)
  LEFT JOIN weights wl ON wl.group_id = s.group_id AND wl.lb = lvl.level_bucket LEFT JOIN weights wa ON wa.group_id = s.group_id AND wa.lb = 'any'
), agg AS (
  SELECT job_id, count(*) FILTER (WHERE pr = 'required') AS required_skills, count(*) FILTER (WHERE pr = 'preferred') AS preferred_skills,
    coalesce(sum(CASE WHEN group_id IS NULL THEN 0 WHEN pr = 'required' THEN w WHEN pr = 'preferred' THEN w * 0.35 END), 0) AS pts,
    count(*) FILTER (WHERE pr = 'required' AND group_id = 'G1') AS req_de, count(*) FILTER (WHERE pr = 'required' AND group_id = 'G2') AS req_ml,
    count(*) FILTER (WHERE pr = 'required' AND group_id = 'G3') AS req_cloud
  FROM tagged GROUP BY 1
), calc AS (
  SELECT l.job_id, l.level_bucket AS lb, coalesce(required_skills, 0) AS required_skills, coalesce(preferred_skills, 0) AS preferred_skills,
    CAST(round(CAST(coalesce(pts, 0) AS DECIMAL(28,8)), 4) AS DOUBLE) AS seniority_points,
    coalesce(req_de, 0) AS req_de, coalesce(req_ml, 0) AS req_ml, coalesce(req_cloud, 0) AS req_cloud
  FROM lvl l LEFT JOIN agg USING (job_id)
), fit AS (
  SELECT *, least(25, CASE WHEN lb = 'entry' AND seniority_points >= 7.5 THEN 22 WHEN lb = 'entry' AND seniority_points >= 5.5 THEN 14
      WHEN lb = 'entry' AND seniority_points >= 4 THEN 8 WHEN lb = 'associate' AND seniority_points >= 8.5 THEN 14
      WHEN lb = 'associate' AND seniority_points >= 6.5 THEN 8 WHEN lb = 'mid' AND seniority_points >= 10 THEN 8 ELSE 0 END
    + CASE WHEN lb = 'entry' AND required_skills >= 12 THEN 10 WHEN lb = 'entry' AND required_skills >= 9 THEN 6
      WHEN lb IN ('associate', 'mid') AND required_skills >= 14 THEN 6 ELSE 0 END
    + CASE WHEN lb = 'entry' AND req_de >= 1 AND req_ml >= 1 AND req_cloud >= 1 THEN 10 WHEN lb = 'entry' AND req_ml >= 2 THEN 6 ELSE 0 END) AS plausibility_penalty,
    concat_ws('|', CASE WHEN lb = 'entry' AND seniority_points >= 5.5 THEN 'entry_senior_stack' END,
      CASE WHEN lb = 'entry' AND required_skills >= 9 THEN 'entry_fullstack_scope' END,
      CASE WHEN lb = 'entry' AND req_de >= 1 AND req_ml >= 1 AND req_cloud >= 1 THEN 'entry_cross_discipline' END,
      CASE WHEN lb = 'associate' AND seniority_points >= 8.5 THEN 'associate_senior_stack' END) AS fit_flags
  FROM calc)"""

HONESTY = FIT + r""", base AS (
  SELECT p.*, coalesce(r.role_name, '') AS title, coalesce(p.experience_level, 'unknown') AS lv, coalesce(p.workplace_type, 'unknown') AS wp,
    f.required_skills AS req, f.plausibility_penalty AS pp, f.fit_flags,
    salary_min IS NULL AND salary_max IS NULL AS no_pay,
    coalesce(salary_min > 0 AND salary_max / salary_min >= 2.5, false) AS wide,
    (salary_min IS NOT NULL OR salary_max IS NOT NULL) AND coalesce(trim(salary_period), '') = '' AS no_period,
    regexp_matches(description_text, '(?i)\b(doe|competitive|commensurate)\b') AS coy,
    regexp_matches(description_text, '(?i)\b\d+\+\s*(years|yrs)\b') AS yrs,
    regexp_matches(description_text, '(?i)\b(on[- ]?site|onsite|in office)\b') AS ons,
    regexp_matches(description_text, '(?i)\bon[- ]call\b') AND regexp_matches(description_text, '(?i)\blean team\b') AND regexp_matches(description_text, '(?i)\bfast[- ]paced\b') AS heavy
  FROM f_postings p LEFT JOIN f_roles r USING (role_id) LEFT JOIN fit f USING (job_id)
  WHERE p.data_tier = 1 AND p.status = 'raw' AND length(description_text) > 100
), pen AS (
  SELECT *, CASE WHEN no_pay THEN 25 ELSE 0 END + CASE WHEN wide THEN 10 ELSE 0 END + CASE WHEN coy THEN 10 ELSE 0 END + CASE WHEN no_period THEN 5 ELSE 0 END AS pay_penalty,
    least(15, 3 * (CASE WHEN regexp_matches(description_text, '(?i)rock ?star') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(description_text, '(?i)ninja') THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(description_text, '(?i)wear many hats') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(description_text, '(?i)self[- ]starter') THEN 1 ELSE 0 END
      + CASE WHEN regexp_matches(description_text, '(?i)work hard,? play hard') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(description_text, '(?i)every applicant') THEN 1 ELSE 0 END)) AS vague_penalty,
    least(25, CASE WHEN lv = 'entry' AND req >= 14 THEN 25 WHEN lv = 'entry' AND req >= 10 THEN 15 ELSE 0 END + CASE WHEN yrs THEN 10 ELSE 0 END + CASE WHEN heavy THEN 10 ELSE 0 END) AS scope_penalty,
    least(15, CASE WHEN lv = 'entry' AND regexp_matches(title, '(?i)\b(senior|sr\.|lead|principal|staff)\b') THEN 8 ELSE 0 END + CASE WHEN wp = 'remote' AND ons THEN 10 ELSE 0 END) AS consistency_penalty,
    0 AS eeo_penalty, coalesce(pp, 0) AS plausibility_penalty,
    CASE WHEN lv = 'senior' AND salary_max < 80000 THEN 15 WHEN lv IN ('entry', 'associate') AND salary_min > 200000 THEN 10 ELSE 0 END AS salary_plausibility_penalty,
    CASE WHEN lv IN ('entry', 'associate') AND regexp_matches(title, '(?i)\b(senior|sr\.|lead|principal|staff|director|vp|head of)\b') THEN 12
         WHEN lv = 'mid' AND regexp_matches(title, '(?i)\b(director|vp|vice president|head of)\b') THEN 8 ELSE 0 END AS title_inflation_penalty
  FROM base
), honesty AS (
  SELECT job_id, CAST(greatest(0, 100 - pay_penalty - vague_penalty - scope_penalty - consistency_penalty - eeo_penalty - plausibility_penalty
      - salary_plausibility_penalty - title_inflation_penalty) AS BIGINT) AS honesty_score,
    pay_penalty, vague_penalty, scope_penalty, consistency_penalty, eeo_penalty, plausibility_penalty, salary_plausibility_penalty, title_inflation_penalty,
    concat_ws('|', nullif(fit_flags, ''), CASE WHEN no_pay THEN 'no_salary' END, CASE WHEN coy THEN 'doe_competitive' END, CASE WHEN no_period THEN 'salary_missing_period' END,
      CASE WHEN wide THEN 'salary_too_wide' END, CASE WHEN lv = 'entry' AND req >= 10 THEN 'entry_heavy_requirements' END, CASE WHEN yrs THEN 'years_requirement' END,
      CASE WHEN heavy THEN 'oncall_lean_fastpaced' END, CASE WHEN lv = 'entry' AND regexp_matches(title, '(?i)\b(senior|sr\.|lead|principal|staff)\b') THEN 'entry_title_senior' END,
      CASE WHEN wp = 'remote' AND ons THEN 'remote_but_onsite_language' END, CASE WHEN plausibility_penalty >= 10 THEN 'senior_stack_mismatch' END,
      CASE WHEN salary_plausibility_penalty > 0 THEN 'salary_level_mismatch' END, CASE WHEN title_inflation_penalty > 0 THEN 'title_inflation' END) AS flags
  FROM pen)"""

DIMS = """d_sec AS (SELECT lower(company_name) AS nk, max(sector) AS fs, max(employee_count) AS ec FROM f_companies GROUP BY 1),
d_act AS (SELECT company_id, count(*) AS n FROM f_postings WHERE status = 'raw' AND data_tier = 1 GROUP BY 1),
dims AS (
  SELECT c.company_id, trim(c.company_name) AS company_name, nullif(trim(c.company_type), '') AS company_type, coalesce(c.sector, fs) AS sector,
    coalesce(n, 0) AS active_roles, ec AS employee_count,
    CASE WHEN ec <= 5000 THEN 'growth' WHEN ec > 5000 THEN 'enterprise' END AS company_tier,
    CASE WHEN ec > 0 AND n > 0 THEN CAST(round(CAST(n / ec * 100 AS DECIMAL(28,8)), 2) AS DOUBLE) END AS hiring_intensity_pct,
    CASE WHEN ec > 0 AND n > 0 THEN CAST(round(CAST(n / ec * 1000 AS DECIMAL(28,8)), 2) AS DOUBLE) END AS hiring_intensity_per_1k,
    CASE WHEN ec <= 5000 THEN 'per 100 employees' WHEN ec > 5000 THEN 'per 1,000 employees' END AS intensity_label
  FROM f_companies c LEFT JOIN d_sec ON d_sec.nk = lower(c.company_name) LEFT JOIN d_act USING (company_id))"""
