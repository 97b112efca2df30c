"""Benchmarks, scores and company marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import columns as C
from ..operators.filters import search_companies
from ..plans import core, scores
from . import shared as S
from .registry import query, r


@query("bi_1_fct_jobs", f"WITH {S.PAY}, {S.HONESTY} SELECT j.job_id, company_id, role_id, status, data_tier, pay_period, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual, CASE status WHEN 'raw' THEN DATE '{AS_OF}' - posted_date ELSE last_seen_at - posted_date END AS days_open, last_seen_at - ingested_at AS days_tracked, honesty_score FROM jobs j LEFT JOIN honesty USING (job_id)")
def _(t):
    return core.fct_jobs(t.postings, S.honesty(t), AS_OF).select(
        "job_id", "company_id", "role_id", "status", "data_tier", "pay_period", "salary_min_annual", "salary_max_annual", "days_open", "days_tracked", "honesty_score")


BRIDGE = "bridge AS (SELECT q.*, skill_name FROM (SELECT *, row_number() OVER (PARTITION BY job_id, skill_id ORDER BY confidence DESC NULLS LAST, job_skills_id) AS rn FROM f_job_skills) q JOIN f_skills USING (skill_id) WHERE rn = 1)"


@query("bi_2_skill_demand", f"WITH {S.PAY}, {BRIDGE} SELECT experience_level, workplace_type, skill_name, count(DISTINCT job_id) AS jobs_with_skill, {r('quantile_cont(salary_max_annual, 0.5)', 0)} AS median_salary FROM bridge JOIN jobs USING (job_id) WHERE data_tier = 1 AND coalesce(data_quality, 'ok') = 'ok' AND salary_max_annual IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT job_id) >= 5")
def _(t):
    return core.skill_demand(S.jobs(t), core.bridge_job_skills(t.job_skills, t.skills))


BENCH = f"WITH {S.PAY} SELECT data_tier, ingestion_source, experience_level, workplace_type, loc_state AS state, count(DISTINCT job_id) AS job_count, {r('avg(salary_min_annual)', 0)} AS avg_salary_min, {r('avg(salary_max_annual)', 0)} AS avg_salary_max, {r('quantile_cont(salary_max_annual, 0.25)', 0)} AS p25_salary, {r('quantile_cont(salary_max_annual, 0.5)', 0)} AS median_salary, {r('quantile_cont(salary_max_annual, 0.75)', 0)} AS p75_salary FROM jobs WHERE salary_max_annual BETWEEN 30000 AND 500000 AND data_tier IN (1, 2) AND coalesce(data_quality, 'ok') = 'ok' GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT job_id) >= 3"


@query("bi_3_salary_benchmarks", BENCH)
def salary_benchmarks(t):
    return core.salary_benchmarks(S.jobs(t))


@query("bi_4_market_coverage", f"WITH {S.PAY} SELECT CAST(date_trunc('month', ingested_at) AS DATE) AS month_start, data_tier, ingestion_source, experience_level, workplace_type, count(DISTINCT job_id) AS job_count, count(DISTINCT job_id) FILTER (WHERE salary_max_annual IS NOT NULL) AS jobs_with_salary, {r('quantile_cont(salary_max_annual, 0.5)', 0)} AS median_salary, {r('count(DISTINCT job_id) FILTER (WHERE salary_max_annual IS NOT NULL) * 100.0 / count(DISTINCT job_id)', 1)} AS salary_disclosure_pct FROM jobs WHERE data_tier IN (1, 2) AND coalesce(data_quality, 'ok') = 'ok' GROUP BY 1, 2, 3, 4, 5")
def _(t):
    return core.market_coverage(S.jobs(t))


@query("bi_5_sector_benchmarks", f"""WITH {S.PAY}, {S.HONESTY}, {S.RISK}, g AS (SELECT sector, {r('avg(ghost_probability)', 1)} AS avg_ghost_prob, {r("count(*) FILTER (WHERE ghost_tier IN ('high', 'medium')) * 100.0 / count(*)", 1)} AS pct_likely_ghost FROM risk WHERE sector IS NOT NULL GROUP BY 1),
b AS (SELECT sector, count(DISTINCT job_id) FILTER (WHERE status = 'raw') AS active_roles, count(DISTINCT job_id) AS total_roles,
 {r('avg(CASE WHEN salary_max_annual IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100', 1)} AS transparency_pct, {r('avg(honesty_score)', 1)} AS avg_honesty_score,
 {r("quantile_cont(salary_max_annual, 0.5) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000 AND status = 'raw')", 0)} AS median_max_salary,
 {r('avg(salary_max_annual) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000)', 0)} AS avg_max_salary,
 {r(f"avg(DATE '{AS_OF}' - posted_date) FILTER (WHERE status = 'raw')", 0)} AS avg_days_open,
 {r("count(DISTINCT job_id) FILTER (WHERE status = 'raw') * 100.0 / count(DISTINCT job_id)", 1)} AS pct_still_active,
 {r("count(DISTINCT job_id) FILTER (WHERE status = 'raw' AND workplace_type = 'remote') * 100.0 / nullif(count(DISTINCT job_id) FILTER (WHERE status = 'raw'), 0)", 1)} AS pct_remote
 FROM jobs j JOIN f_companies c USING (company_id) LEFT JOIN honesty USING (job_id) WHERE data_tier = 1 AND c.sector IS NOT NULL GROUP BY 1 HAVING count(DISTINCT job_id) >= 10)
SELECT b.*, avg_ghost_prob, pct_likely_ghost FROM b LEFT JOIN g USING (sector)""")
def _(t):
    jobs, risk = S.staged_together(core.fct_jobs(t.postings, S.honesty(t), AS_OF), S.risk(t))
    return core.sector_benchmarks(jobs, t.companies, risk, AS_OF)


DIFF = """sk AS (SELECT job_id, skill_id, lower(skill_priority) AS pr FROM f_job_skills),
fr AS (SELECT skill_id, count(DISTINCT sk.job_id) / (SELECT count(*) FROM f_postings WHERE data_tier = 1) AS pct FROM sk JOIN f_postings p ON p.job_id = sk.job_id AND p.data_tier = 1 GROUP BY 1),
jsc AS (SELECT job_id, count(*) AS skill_count FROM sk JOIN f_skills USING (skill_id) WHERE pr = 'required' AND difficulty_relevant GROUP BY 1),
jnr AS (SELECT job_id, avg(CASE WHEN pct < 0.05 THEN 1.0 ELSE 0.0 END) AS niche FROM sk JOIN f_skills USING (skill_id) LEFT JOIN fr USING (skill_id) WHERE difficulty_relevant GROUP BY 1),
dj AS (SELECT j.job_id, j.company_id, c.company_name, c.sector, j.experience_level, j.salary_max_annual, skill_count, niche FROM jobs j JOIN f_companies c USING (company_id) LEFT JOIN jsc USING (job_id) LEFT JOIN jnr USING (job_id) WHERE data_tier = 1 AND c.sector IS NOT NULL),
dm AS (SELECT sector, experience_level, quantile_cont(salary_max_annual, 0.5) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000) AS med, avg(skill_count) AS avg_skills FROM dj WHERE experience_level IS NOT NULL GROUP BY 1, 2),
lv AS (SELECT company_id, experience_level FROM (SELECT company_id, experience_level, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, experience_level) AS rn FROM dj WHERE experience_level IS NOT NULL GROUP BY 1, 2) q WHERE rn = 1),
cb AS (SELECT company_id, company_name, sector, count(DISTINCT job_id) AS total_roles, """ + r("avg(CASE WHEN salary_max_annual IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100", 1) + """ AS tp,
  avg(salary_max_annual) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000) AS am, avg(skill_count) AS sc, avg(niche) AS nr FROM dj GROUP BY 1, 2, 3 HAVING count(DISTINCT job_id) >= 5),
sd AS (SELECT cb.*, lv.experience_level AS primary_level, med, """ + r("100 - tp", 1) + """ AS opacity_score,
  CASE WHEN am IS NOT NULL AND med IS NOT NULL THEN CASE WHEN am >= med THEN 0.0 ELSE least(100.0, """ + r("(med - am) / med * 100", 1) + ") END ELSE " + r("10 + (100 - tp) * 0.5", 1) + """ END AS salary_below_score,
  CASE WHEN coalesce(avg_skills, 0) = 0 OR sc IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, """ + r("sc / avg_skills * 50", 1) + """)) END AS complexity_score, """ + r("nr * 100", 1) + """ AS rarity_score
  FROM cb LEFT JOIN lv USING (company_id) LEFT JOIN dm ON dm.sector = cb.sector AND dm.experience_level = lv.experience_level),
rs AS (SELECT *, """ + r("rarity_score * 0.30 + complexity_score * 0.25 + salary_below_score * 0.30 + opacity_score * 0.15", 2) + """ AS raw_score FROM sd),
difficulty AS (SELECT company_id, company_name, sector, total_roles, primary_level, """ + r("(raw_score - (SELECT min(raw_score) FROM rs)) / nullif((SELECT max(raw_score) - min(raw_score) FROM rs), 0) * 100", 1) + """ AS difficulty_score, raw_score, rarity_score,
  complexity_score, salary_below_score, opacity_score, """ + r("tp", 0) + " AS pct_transparent, " + r("am", 0) + " AS avg_max_salary, " + r("med", 0) + " AS sector_median FROM rs)"


@query("bi_6_hiring_difficulty", f"WITH {S.PAY}, {DIFF} SELECT * FROM difficulty")
def _(t):
    return S.difficulty(t)


CARD = f"""{S.PAY}, {S.HONESTY}, {S.RISK}, {DIFF}, {S.DIMS},
pub AS (SELECT j.*, h.honesty_score, g.ghost_probability, g.ghost_tier FROM jobs j LEFT JOIN honesty h USING (job_id) LEFT JOIN risk g USING (job_id) WHERE data_tier = 1 AND is_public),
m1 AS (SELECT company_id, experience_level FROM (SELECT company_id, experience_level, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, experience_level) AS rn FROM pub WHERE experience_level IS NOT NULL GROUP BY 1, 2) q WHERE rn = 1),
m2 AS (SELECT company_id, workplace_type FROM (SELECT company_id, workplace_type, row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, workplace_type) AS rn FROM pub GROUP BY 1, 2) q WHERE rn = 1),
act AS (SELECT company_id, count(DISTINCT job_id) AS published_roles, {r('avg(salary_max_annual) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000)', 0)} AS avg_max_salary,
  {r('avg(CASE WHEN salary_max_annual IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100', 1)} AS transparency_pct, {r('avg(honesty_score)', 1)} AS avg_honesty_score,
  {r('avg(ghost_probability)', 1)} AS avg_ghost_probability, count(*) FILTER (WHERE ghost_tier = 'high') AS high_ghost_count, count(ghost_tier) AS scoreable_jobs FROM pub GROUP BY 1 HAVING count(DISTINCT job_id) >= 3),
ts AS (SELECT company_id, string_agg(skill_name, ', ' ORDER BY n DESC, skill_name) AS top_skills FROM (SELECT company_id, skill_name, count(*) AS n FROM pub JOIN sk USING (job_id) JOIN f_skills USING (skill_id) WHERE pr = 'required' AND difficulty_relevant GROUP BY 1, 2) q GROUP BY 1),
hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(company_name) ORDER BY difficulty_score DESC NULLS LAST, rarity_score DESC NULLS LAST, complexity_score DESC NULLS LAST, salary_below_score DESC NULLS LAST) AS rn FROM difficulty) q WHERE rn = 1),
card0 AS (SELECT d.company_id, d.company_name, d.sector, company_tier, employee_count, published_roles, act.avg_max_salary, transparency_pct, avg_honesty_score, m1.experience_level AS primary_level, m2.workplace_type AS primary_workplace,
  difficulty_score, rarity_score, complexity_score, salary_below_score, avg_ghost_probability, high_ghost_count, scoreable_jobs, {r('high_ghost_count * 100.0 / nullif(scoreable_jobs, 0)', 1)} AS ghost_rate_pct, top_skills,
  row_number() OVER (PARTITION BY d.company_name ORDER BY published_roles DESC, d.company_id) AS rn
  FROM dims d JOIN act USING (company_id) LEFT JOIN m1 USING (company_id) LEFT JOIN m2 USING (company_id) LEFT JOIN ts USING (company_id) LEFT JOIN hd ON lower(hd.company_name) = lower(d.company_name)),
card AS (SELECT * EXCLUDE (rn) FROM card0 WHERE rn = 1)"""
CARD_COLS = ["company_id", "company_name", "sector", "company_tier", "employee_count", "published_roles", "avg_max_salary", "transparency_pct", "avg_honesty_score", "primary_level",
             "primary_workplace", "difficulty_score", "rarity_score", "complexity_score", "salary_below_score", "avg_ghost_probability", "high_ghost_count", "scoreable_jobs", "ghost_rate_pct", "top_skills"]


def scorecard(t):
    # Only what the card reads is staged.
    public = S.jobs(t).select("job_id", "company_id", "data_tier", "is_public", "salary_max_annual", "experience_level", "workplace_type")
    jobs, honesty, risk, difficulty = S.staged_together(public, S.honesty(t).select("job_id", "honesty_score"), S.risk(t).select("job_id", "ghost_probability", "ghost_tier"), S.difficulty(t))
    return scores.company_scorecard(S.dims(t), jobs, honesty, risk, difficulty, t.job_skills, t.skills)


@query("bi_7_company_scorecard", f"WITH {CARD} SELECT * FROM card")
def _(t):
    return scorecard(t).select(*CARD_COLS)


@query("flt_7_search_companies", f"""
WITH {CARD}, h AS (SELECT * FROM card WHERE published_roles >= 4)
SELECT (SELECT count(*) FROM h) AS total, company_name, published_roles, avg_max_salary, difficulty_score, substring(top_skills, 1, 200) AS top_skills
FROM h ORDER BY avg_max_salary DESC NULLS LAST, company_name LIMIT 30 OFFSET 5""")
def _(t):
    # Staged: the total and the page are both read from it.
    total, page = search_companies(S.staged(scorecard(t)), min_roles=4, sort_by="avg_max_salary", limit=30, offset=5)
    return page.select(total.scalar().alias("total"), "company_name", "published_roles", "avg_max_salary", "difficulty_score", "top_skills")


@query("bi_8_honesty_by_company", f"WITH {S.PAY}, {S.HONESTY} SELECT company_id, company_name, sector, count(DISTINCT job_id) AS scored_jobs, {r('avg(honesty_score)', 1)} AS avg_honesty_score, CAST(min(honesty_score) AS DOUBLE) AS min_honesty_score, CAST(max(honesty_score) AS DOUBLE) AS max_honesty_score, {r('quantile_cont(honesty_score, 0.5)', 1)} AS median_honesty_score, {r('avg(CASE WHEN salary_max_annual IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100', 1)} AS transparency_pct, count(*) FILTER (WHERE honesty_score >= 90) AS high_honesty_jobs, count(*) FILTER (WHERE honesty_score < 70) AS low_honesty_jobs FROM honesty JOIN jobs USING (job_id) JOIN f_companies c USING (company_id) WHERE data_tier = 1 AND status = 'raw' AND c.sector IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT job_id) >= 3")
def _(t):
    return core.honesty_by_company(S.honesty(t), S.jobs(t), t.companies)


@query("bi_9_ghost_index", f"WITH {S.RISK} SELECT job_id, company_name, sector, role_name, ingestion_source, posted_date, days_open_raw, days_open_capped, {r('base', 0)} AS baseline_days, baseline_type, baseline_sample_size, {r('age', 1)} AS age_risk, reappearance_count, longest_gap_days, CAST(reappearance_risk AS DOUBLE) AS reappearance_risk, related_posting_count, related_source_count, CAST(repost_risk AS DOUBLE) AS repost_risk, ghost_probability, ghost_tier, score_confidence FROM risk")
def _(t):
    return S.risk(t).drop("company_id")


@query("bi_10_honesty_score", f"WITH {S.HONESTY} SELECT * FROM honesty")
def _(t):
    return S.honesty(t).withColumn("flags", F.concat_ws("|", "flags"))


@query("bi_11_plausibility", f"WITH {S.FIT} SELECT job_id, lb AS level_bucket, required_skills, preferred_skills, seniority_points, req_de, req_ml, req_cloud, plausibility_penalty, fit_flags AS plausibility_flags FROM fit")
def _(t):
    return S.fit(t).withColumn("plausibility_flags", F.concat_ws("|", "plausibility_flags"))


@query("bi_42_honesty_latest", f"WITH {S.HONESTY} SELECT p.job_id, company_name, role_name, p.experience_level, p.salary_max, p.posted_date, honesty_score, pay_penalty, scope_penalty, flags FROM f_postings p LEFT JOIN f_companies c USING (company_id) LEFT JOIN f_roles USING (role_id) LEFT JOIN honesty USING (job_id)")
def _(t):
    out = core.honesty_latest(t.postings, t.companies, t.roles, S.honesty(t))
    return out.select("job_id", "company_name", "role_name", "experience_level", "salary_max", "posted_date", "honesty_score", "pay_penalty", "scope_penalty",
                      F.when(F.col("flags").isNotNull(), F.concat_ws("|", "flags")).alias("flags"))


@query("bi_43_repost_warning", f"WITH {S.RISK} SELECT job_id, CASE WHEN reappearance_count > 0 THEN 'Reposted' END AS label, CASE WHEN reappearance_count > 0 THEN reappearance_count END AS count FROM risk")
def _(t):
    return scores.repost_warning(S.risk(t)).select("job_id", F.col("repost_warning.label").alias("label"), F.col("repost_warning.count").alias("count"))


@query("lc_5_classify_reposts", f"WITH {S.REPOSTS} SELECT event_id, job_id, company_id, observed_on, gone_at AS prior_observed_at, cohort AS same_refresh_cohort, gap_days, signal_class FROM reposts")
def _(t):
    return S.reposts(t).select("event_id", "job_id", "company_id", "observed_on", "prior_observed_at", "same_refresh_cohort", "gap_days", "signal_class")
