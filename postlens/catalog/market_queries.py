"""Market reports, indexes, answers and operational reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF, RADAR_DAY
from ..functions.columns import ROLE_FAMILIES
from ..plans import market as M
from ..plans import ops as O
from ..session import cut_lineage
from . import shared as S
from .mart_queries import CARD, scorecard
from .registry import query, r
from .relational_queries import FAMILY_SQL, FEED, US_PLACE, feed

MONTHLY = f"""SELECT DATE '{RADAR_DAY}' AS snapshot_date, CAST(date_trunc('month', posted_date) AS DATE) AS month_bucket, skill_id, coalesce(experience_level, 'unknown') AS experience_level, lower(skill_priority) AS skill_priority,
 count(DISTINCT job_id) AS jobs_count, {r('avg(salary_min)', 2)} AS avg_salary_min, {r('avg(salary_max)', 2)} AS avg_salary_max FROM f_job_skills JOIN f_postings USING (job_id) WHERE posted_date >= DATE '2001-02-01' GROUP BY 1, 2, 3, 4, 5"""


def monthly(t):
    return M.skill_monthly(t.postings, t.job_skills, RADAR_DAY, "posted")


@query("bi_19_skill_monthly_posted", MONTHLY)
def _(t):
    return monthly(t)


@query("bi_19_skill_monthly_found", f"""SELECT DATE '{RADAR_DAY}' AS snapshot_date, CAST(date_trunc('month', date_found) AS DATE) AS month_bucket, skill_id, coalesce(experience_level, 'unknown') AS experience_level, lower(skill_priority) AS skill_priority,
 count(DISTINCT job_id) AS jobs_count, {r("avg(CASE WHEN salary_period = 'year' THEN salary_min END)", 2)} AS avg_salary_min, {r("avg(CASE WHEN salary_period = 'year' THEN salary_max END)", 2)} AS avg_salary_max FROM f_job_skills JOIN f_postings USING (job_id) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return M.skill_monthly(t.postings, t.job_skills, RADAR_DAY, "found")


def emerging_sql(extra: str) -> str:
    cols = f"skill_id{', ' + extra if extra else ''}"
    return f"""WITH m AS ({MONTHLY}), a AS (SELECT {cols}, CAST(coalesce(sum(jobs_count) FILTER (WHERE month_bucket = DATE '2001-06-01'), 0) AS BIGINT) AS prev_month_jobs, CAST(coalesce(sum(jobs_count) FILTER (WHERE month_bucket = DATE '2001-07-01'), 0) AS BIGINT) AS cur_month_jobs FROM m GROUP BY ALL)
SELECT a.*, skill_name, cur_month_jobs - prev_month_jobs AS delta_jobs FROM a JOIN f_skills USING (skill_id) WHERE cur_month_jobs > 0"""


@query("bi_20_emerging_skills", emerging_sql(""))
def _(t):
    return M.emerging_skills(monthly(t), t.skills, "2001-07-15")


@query("bi_20_emerging_by_level", emerging_sql("experience_level"))
def _(t):
    return M.emerging_skills(monthly(t), t.skills, "2001-07-15", ["experience_level"])


@query("bi_21_publication_funnel", f"""SELECT ingestion_source, count(*) FILTER (WHERE status = 'raw') AS active_rows, count(*) FILTER (WHERE status = 'raw' AND data_tier = 1) AS tier1_rows,
 count(*) FILTER (WHERE status = 'raw' AND data_tier = 1 AND (loc_country IN ('US', 'United States', 'USA') OR (loc_country IS NULL AND loc_state IS NOT NULL) OR (loc_country = 'unknown' AND (ingestion_source IN ('greenhouse', 'lever', 'ashby') OR (ingestion_source = 'workday' AND workplace_type = 'remote'))))) AS us_candidate_rows,
 count(*) FILTER (WHERE status = 'raw' AND data_tier = 1 AND domain IS NOT NULL) AS classified_rows, count(*) FILTER (WHERE status = 'raw' AND data_tier = 1 AND domain IS NULL) AS unresolved_domain_rows,
 count(*) FILTER (WHERE status = 'raw' AND data_tier = 1 AND domain IS NOT NULL AND role_id IS NOT NULL AND {US_PLACE} AND lower(company_name) NOT LIKE '%firm 77%' AND lower(company_name) NOT LIKE '%firm 5 inc%' AND lower(company_name) NOT LIKE '%firm 41 %') AS publishable_rows,
 max(last_seen_at) AS latest_seen_at FROM f_postings LEFT JOIN f_companies USING (company_id) GROUP BY 1""")
def _(t):
    return O.publication_funnel(t.postings, t.companies, S.EXCLUSIONS)


@query("bi_22_domain_funnel", "SELECT ingestion_source, coalesce(domain, 'unresolved') AS domain, count(*) AS jobs FROM f_postings WHERE data_tier = 1 AND status = 'raw' GROUP BY 1, 2")
def _(t):
    return O.domain_funnel(t.postings)


@query("bi_22_unresolved_titles", "SELECT lower(trim(role_name)) AS normalized_title, ingestion_source, count(*) AS active_jobs, max(last_seen_at) AS last_seen_at FROM f_postings JOIN f_roles USING (role_id) WHERE data_tier = 1 AND status = 'raw' AND domain IS NULL GROUP BY 1, 2")
def _(t):
    return O.unresolved_titles(t.postings, t.roles)


@query("bi_22_scope_report", "SELECT scope_status, role_name, count(*) AS n FROM f_postings JOIN f_roles USING (role_id) WHERE scope_status NOT LIKE 'accepted%' GROUP BY 1, 2 ORDER BY n DESC, scope_status, role_name LIMIT 50")
def _(t):
    return O.scope_report(t.postings, t.roles)


METROS = {"seattle": ("WA", ["seattle", "bellevue"]), "chicago": ("IL", ["chicago"]), "austin": ("TX", ["austin"]), "new-york": ("NY", ["new york", "brooklyn"])}
STATES = ("CA", "NY", "TX", "WA", "IL")
LOCS = "[CASE WHEN workplace_type = 'remote' THEN 'remote' END, " + ", ".join(
    f"CASE WHEN upper(loc_state) = '{st}' AND ({' OR '.join(f'''lower(loc_city) LIKE '%{c}%' ''' for c in cs)}) THEN '{m}' END" for m, (st, cs) in METROS.items()) + ", " + ", ".join(
    f"CASE WHEN upper(loc_state) = '{s}' THEN '{s.lower()}' END" for s in STATES) + "]"


@query("bi_23_role_location_index", f"SELECT role_category, location_slug, count(*) AS job_count FROM (SELECT lower(trim(role_category)) AS role_category, unnest({LOCS}) AS location_slug FROM f_postings WHERE is_public AND trim(role_category) <> '') q WHERE location_slug IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5")
def _(t):
    return M.role_location_index(t.postings, METROS, STATES)


MID = "coalesce((salary_min_annual + salary_max_annual) / 2, salary_min_annual, salary_max_annual)"


def spread(mid):
    return f"{r(f'quantile_cont({mid}, 0.5)', 0)} AS median_salary, {r(f'quantile_cont({mid}, 0.25)', 0)} AS p25_salary, {r(f'quantile_cont({mid}, 0.75)', 0)} AS p75_salary"


@query("bi_24_company_index", f"WITH {S.PAY}, {S.RISK}, x AS (SELECT j.*, {MID} AS mid, company_slug, c.company_name, c.sector, ghost_probability / 100.0 AS g FROM jobs j JOIN f_companies c USING (company_id) LEFT JOIN risk USING (job_id) WHERE is_public) SELECT company_id, company_slug, company_name, sector, count(*) AS job_count, {spread('mid')}, {r('avg(mid)', 0)} AS avg_comp_annual, {r('avg(g)', 4)} AS avg_ghost, {r('quantile_cont(g, 0.5)', 4)} AS median_ghost, {r('avg(CASE WHEN mid IS NOT NULL THEN 1.0 ELSE 0.0 END)', 4)} AS salary_disclosure_rate FROM x GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5")
def _(t):
    return M.company_index(S.jobs(t), t.companies, S.staged(S.risk(t)))


@query("bi_24_skill_index", f"WITH {S.PAY}, x AS (SELECT job_id, {MID} AS mid FROM jobs WHERE is_public) SELECT skill_id, skill_name, count(DISTINCT job_id) AS job_count, {spread('mid')}, (SELECT {r('quantile_cont(mid, 0.5)', 0)} FROM x) AS market_median_salary FROM x JOIN f_job_skills USING (job_id) JOIN f_skills USING (skill_id) GROUP BY 1, 2 HAVING count(DISTINCT job_id) >= 5")
def _(t):
    return M.skill_index(S.jobs(t), t.job_skills, t.skills)


CUR = "data_tier = 1 AND is_public AND role_id IS NOT NULL AND coalesce(loc_country, 'unknown') IN ('US', 'unknown')"
BAND = "salary_max_annual BETWEEN 50000 AND 500000"
PAYCOLS = f"{r(f'avg(salary_max_annual) FILTER (WHERE {BAND})', 0)} AS avg_max_salary, {r(f'quantile_cont(salary_max_annual, 0.5) FILTER (WHERE {BAND})', 0)} AS median_max_salary"
TRANSP = r("count(salary_max_annual) * 100.0 / count(*)", 1)


@query("bi_25_market_overview", f"WITH {S.PAY}, {S.HONESTY} SELECT count(*) AS total_active_roles, count(DISTINCT company_id) AS companies_hiring, {TRANSP} AS salary_transparency_pct, {PAYCOLS}, {r('avg(honesty_score)', 1)} AS avg_honesty_score, max(ingested_at) AS last_updated FROM jobs LEFT JOIN honesty USING (job_id) WHERE {CUR}")
def _(t):
    return M.market_overview(*S.staged_together(S.jobs(t), S.honesty(t)))


@query("bi_25_ghost_tiers", f"WITH {S.RISK} SELECT ghost_tier, count(*) AS job_count, {r('avg(ghost_probability)', 1)} AS avg_probability, min(ghost_probability) AS min_probability, max(ghost_probability) AS max_probability FROM risk GROUP BY 1")
def _(t):
    return M.risk_tiers(S.risk(t))


@query("bi_25_source_counts", f"WITH {S.PAY} SELECT ingestion_source, count(*) AS active_roles FROM jobs WHERE {CUR} GROUP BY 1")
def _(t):
    return M.source_counts(S.jobs(t))


@query("bi_26_market_roles", f"WITH {S.PAY} SELECT {FAMILY_SQL} AS role_family, experience_level, count(DISTINCT job_id) AS active_roles, {PAYCOLS}, {r('avg(salary_min_annual) FILTER (WHERE salary_min_annual BETWEEN 30000 AND 500000)', 0)} AS avg_min_salary, {TRANSP} AS transparency_pct, {r('''count(*) FILTER (WHERE workplace_type = 'remote') * 100.0 / count(*)''', 0)} AS remote_pct FROM jobs JOIN f_roles USING (role_id) WHERE {CUR} GROUP BY 1, 2")
def _(t):
    return M.market_roles(S.jobs(t), t.roles, S.FAMILIES)


@query("bi_26_market_skills", f"WITH {S.PAY}, pb AS (SELECT * FROM jobs WHERE data_tier = 1 AND is_public), mk AS (SELECT avg(salary_max_annual) FILTER (WHERE {BAND}) AS m FROM pb) SELECT skill_name, count(DISTINCT job_id) AS jobs_requiring, {r(f'avg(salary_max_annual) FILTER (WHERE {BAND})', 0)} AS avg_max_salary, {r(f'(avg(salary_max_annual) FILTER (WHERE {BAND}) - (SELECT m FROM mk)) / (SELECT m FROM mk) * 100', 1)} AS salary_premium_pct, {r('''count(*) FILTER (WHERE lower(skill_priority) = 'required') * 100.0 / count(*)''', 0)} AS required_pct FROM f_job_skills JOIN f_skills USING (skill_id) JOIN pb USING (job_id) JOIN f_roles USING (role_id) WHERE difficulty_relevant GROUP BY 1 HAVING count(DISTINCT job_id) >= 20 ORDER BY jobs_requiring DESC, skill_name LIMIT 50")
def _(t):
    return M.market_skills(S.jobs(t), t.roles, t.job_skills, t.skills)


@query("bi_26_market_sectors", f"WITH {S.PAY}, {S.HONESTY} SELECT c.sector, count(DISTINCT job_id) AS active_roles, count(DISTINCT company_id) AS companies, {PAYCOLS}, {TRANSP} AS transparency_pct, {r('avg(honesty_score)', 1)} AS avg_honesty_score FROM jobs JOIN f_companies c USING (company_id) LEFT JOIN honesty USING (job_id) WHERE data_tier = 1 AND is_public AND c.sector IS NOT NULL GROUP BY 1 HAVING count(DISTINCT job_id) >= 10")
def _(t):
    jobs, honesty = S.staged_together(S.jobs(t), S.honesty(t))
    return M.market_sectors(jobs, t.companies, honesty)


@query("bi_27_company_flags", f"WITH {CARD} SELECT company_id, concat_ws('|', CASE WHEN salary_below_score > 30 THEN 'underpaying' END, CASE WHEN complexity_score > 70 THEN 'overspecified' END, CASE WHEN avg_ghost_probability > 60 THEN 'stale_risk' END, CASE WHEN rarity_score > 15 THEN 'rare_skills' END, CASE WHEN transparency_pct = 0 THEN 'opaque' END) AS action_flags FROM card")
def _(t):
    return M.company_flags(scorecard(t)).select("company_id", F.concat_ws("|", "action_flags").alias("action_flags"))


@query("bi_27_company_roles", f"WITH {S.PAY}, {S.HONESTY}, {S.RISK} SELECT j.company_id, job_id, r.role_name, {FAMILY_SQL.replace('role_name', 'r.role_name')} AS role_family, g.ghost_probability, ghost_tier, honesty_score FROM jobs j JOIN f_roles r USING (role_id) LEFT JOIN risk g USING (job_id) LEFT JOIN honesty USING (job_id) WHERE data_tier = 1 AND is_public")
def _(t):
    risk, honesty = S.staged_together(S.risk(t).select("job_id", "ghost_probability", "ghost_tier", "score_confidence", "age_risk", "reappearance_count", "related_posting_count"), S.honesty(t).select("job_id", "honesty_score"))
    return M.company_roles(S.jobs(t), t.roles, risk, honesty, S.FAMILIES).select("company_id", "job_id", "role_name", "role_family", "ghost_probability", "ghost_tier", "honesty_score")


@query("bi_27_company_skills", f"WITH pb AS (SELECT job_id, company_id FROM f_postings WHERE data_tier = 1 AND is_public), tt AS (SELECT company_id, count(*) AS total FROM pb GROUP BY 1) SELECT company_id, skill_name, lower(skill_priority) AS skill_priority, count(DISTINCT job_id) AS job_count, {r('count(DISTINCT job_id) * 100.0 / max(total)', 1)} AS pct_of_roles FROM pb JOIN f_job_skills USING (job_id) JOIN f_skills USING (skill_id) JOIN tt USING (company_id) GROUP BY 1, 2, 3")
def _(t):
    return M.company_skills(S.jobs(t), t.job_skills, t.skills)


def front(t):
    return M.public_market(feed(t), t.roles, t.job_skills, t.skills, RADAR_DAY)


FD = f"WITH {S.PAY}, {FEED}"


@query("bi_28_public_stats", f"{FD} SELECT count(*) AS active_jobs, count(DISTINCT company_id) AS companies, count(DISTINCT ingestion_source) AS ats_sources, count(DISTINCT domain) AS verticals, {r('avg(CASE WHEN salary_min_annual IS NOT NULL OR salary_max_annual IS NOT NULL THEN 1 ELSE 0 END)', 4)} AS salary_disclosure_rate, count(*) FILTER (WHERE posted_date >= DATE '{RADAR_DAY}' - 1) AS fresh_today, max(date_found) AS indexed_at FROM feed")
def _(t):
    return front(t)["stats"]


@query("bi_28_public_newest", f"{FD} SELECT job_id, role_name, company_name, workplace_type, experience_level, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual, posted_date FROM feed JOIN f_roles USING (role_id) WHERE salary_min_annual IS NOT NULL OR salary_max_annual IS NOT NULL ORDER BY posted_date DESC, job_id LIMIT 6")
def _(t):
    return front(t)["jobs"]


@query("bi_28_public_top_companies", f"{FD} SELECT company_slug, count(*) AS n FROM feed GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, company_slug LIMIT 100")
def _(t):
    return front(t)["companies"]


@query("bi_28_public_top_skills", f"{FD} SELECT lower(trim(skill_slug)) AS slug, count(DISTINCT job_id) AS n FROM feed JOIN f_job_skills USING (job_id) JOIN f_skills USING (skill_id) GROUP BY 1 HAVING count(DISTINCT job_id) >= 5 ORDER BY n DESC, slug LIMIT 50")
def _(t):
    return front(t)["skills"]


def insight(t, slug):
    risk = S.risk(t) if slug == "lowest-risk-companies" else None
    return M.insight(slug, feed(t), t.roles, t.job_skills, t.skills, risk)


BOTH = "salary_min_annual IS NOT NULL AND salary_max_annual IS NOT NULL"


@query("bi_29_lowest_risk_companies", f"{FD}, {S.RISK} SELECT company_id, f.company_name, {r('count(*) FILTER (WHERE ghost_probability > 70) / count(*)', 4)} AS ghost_rate, count(*) AS active_postings FROM feed f JOIN (SELECT job_id, ghost_probability FROM risk) g USING (job_id) GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY ghost_rate, active_postings DESC, company_id LIMIT 25")
def _(t):
    return insight(t, "lowest-risk-companies")


@query("bi_29_top_paid_tech", f"{FD} SELECT job_id, role_name, company_name, (salary_min_annual + salary_max_annual) / 2 AS mid_salary, workplace_type FROM feed JOIN f_roles USING (role_id) WHERE domain IN ('data_ml', 'engineering') AND trim(role_category) IN ('ml_engineering', 'data_science', 'data_engineering') AND {BOTH} ORDER BY mid_salary DESC, job_id LIMIT 25")
def _(t):
    return insight(t, "top-paid-tech")


@query("bi_29_remote_priced", f"{FD} SELECT job_id, role_name, company_name, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual, posted_date FROM feed JOIN f_roles USING (role_id) WHERE domain = 'data_ml' AND workplace_type = 'remote' AND {BOTH} ORDER BY posted_date DESC, job_id LIMIT 30")
def _(t):
    return insight(t, "remote-priced")


@query("bi_29_transparent_sectors", f"{FD} SELECT coalesce(nullif(trim(sector), ''), 'Unknown') AS sector, {r(f'avg(CASE WHEN {BOTH} THEN 1 ELSE 0 END)', 4)} AS disclosure_rate, count(*) AS job_count FROM feed GROUP BY 1 HAVING count(*) >= 25 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 15")
def _(t):
    return insight(t, "transparent-sectors")


@query("bi_29_skill_premiums", f"{FD} SELECT skill_name, {r('quantile_cont((salary_min_annual + salary_max_annual) / 2, 0.5)', 0)} AS median_salary_annual, count(*) AS sample_size FROM feed JOIN f_job_skills USING (job_id) JOIN f_skills USING (skill_id) WHERE {BOTH} GROUP BY 1 HAVING count(*) >= 10 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return insight(t, "skill-premiums")


WHERE = {
    "data-analyst-market": "lower(trim(role_category)) = 'data_analytics'", "data-science-employers": "lower(trim(role_category)) = 'data_science'",
    "remote-product-market": "lower(trim(role_category)) = 'product_management' AND workplace_type = 'remote'",
    "chicago-analyst-pay": "lower(trim(role_category)) = 'data_analytics' AND upper(loc_state) = 'IL' AND lower(loc_city) LIKE '%chicago%'",
    "remote-market": "workplace_type = 'remote'", "pay-transparency": "true",
}
ANSWER_PAY = f"{r('avg(CASE WHEN mid IS NOT NULL THEN 1 ELSE 0 END)', 4)} AS salary_disclosure_rate, {r('quantile_cont(mid, 0.5)', 0)} AS median_salary"
NEW7 = f"count(*) FILTER (WHERE posted_date >= DATE '{RADAR_DAY}' - 7) AS new_jobs_7d"
ROWS = {
    "companies": f"SELECT company_id, company_name, company_slug, count(*) AS active_jobs, {NEW7}, {ANSWER_PAY} FROM z GROUP BY 1, 2, 3 ORDER BY active_jobs DESC, new_jobs_7d DESC, company_name, company_id LIMIT 20",
    "jobs": "SELECT job_id, role_name, company_name, workplace_type, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual, posted_date FROM z WHERE mid IS NOT NULL ORDER BY mid DESC, posted_date DESC, job_id LIMIT 20",
    "roles": f"SELECT trim(role_category) AS role_category, count(*) AS active_jobs, count(DISTINCT company_id) AS companies, {ANSWER_PAY} FROM z WHERE trim(role_category) <> '' GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 20",
    "sectors": f"SELECT coalesce(nullif(trim(sector), ''), 'Unclassified') AS sector, count(*) AS active_jobs, count(mid) AS salary_sample_size, {ANSWER_PAY} FROM z GROUP BY 1 HAVING count(*) >= 25 ORDER BY salary_disclosure_rate DESC, active_jobs DESC, sector LIMIT 20",
}
STATS = f"SELECT count(*) AS active_jobs, count(DISTINCT company_id) AS companies, count(mid) AS salary_sample_size, count(*) FILTER (WHERE workplace_type = 'remote') AS remote_jobs, {NEW7}, {r('quantile_cont(mid, 0.5)', 0)} AS median_salary FROM z"


def _answers():
    for slug, (kind, _cond) in M.SLICES.items():
        z = f"{FD}, z AS (SELECT f.*, role_name, {MID} AS mid FROM feed f JOIN f_roles USING (role_id) WHERE {WHERE[slug]})"
        name = slug.replace("-", "_")
        query(f"bi_30_{name}", f"{z} {ROWS[kind]}")(lambda t, slug=slug: M.market_answer(slug, feed(t), t.roles, RADAR_DAY)[1])
        query(f"bi_30_{name}_stats", f"{z} {STATS}")(lambda t, slug=slug: M.market_answer(slug, feed(t), t.roles, RADAR_DAY)[0])


_answers()


@query("bi_31_fresh_matches", f"""WITH {S.PAY}, x AS (SELECT j.*, company_name, lower(coalesce(role_name, role_category, '')) AS title, CASE WHEN workplace_type = 'remote' THEN 3 WHEN regexp_matches(lower(loc_city), 'seattle|bellevue') THEN 2 ELSE 0 END AS location_rank FROM jobs j JOIN f_companies USING (company_id) LEFT JOIN f_roles USING (role_id)
 WHERE is_public AND data_tier = 1 AND ingestion_source <> 'adzuna' AND coalesce(loc_country, 'unknown') IN ('US', 'unknown') AND posted_date >= DATE '{RADAR_DAY}' - 60),
y AS (SELECT *, CASE WHEN regexp_matches(title, 'data engineer|analytics engineer|data platform') THEN 9 WHEN regexp_matches(title, 'ai engineer|applied ai') THEN 8 WHEN regexp_matches(title, 'machine learning|ml engineer') THEN 5 WHEN regexp_matches(title, 'analyst|analytics|business intelligence') THEN 4 WHEN regexp_matches(lower(description_text), 'python|sql|skill1') THEN 3 ELSE 0 END AS role_rank FROM x
 WHERE NOT regexp_matches(title, 'director|vice president|principal|head of|chief ') AND (salary_max_annual >= 80000 OR (salary_max_annual IS NULL AND regexp_matches(description_text, '\\$[0-9][0-9,]*')))),
z AS (SELECT * FROM y WHERE location_rank > 0 AND role_rank > 0 ORDER BY location_rank DESC, role_rank DESC, posted_date DESC, job_id LIMIT 30),
ct AS (SELECT company_id, string_agg(full_name, ',' ORDER BY fetched_on DESC, full_name) AS known_recruiters FROM (SELECT concat('C', o_custkey % 1500) AS company_id, concat('Person ', o_orderkey) AS full_name, CAST(o_orderdate AS DATE) AS fetched_on FROM orders WHERE o_orderpriority = '1-URGENT') q GROUP BY 1)
SELECT job_id, company_name, title, posted_date AS posted_on, location_rank, role_rank, known_recruiters FROM z LEFT JOIN ct USING (company_id)""")
def _(t):
    contacts = t.sql("SELECT concat('C', o_custkey % 1500) AS company_id, concat('Person ', o_orderkey) AS full_name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Recruiter' ELSE 'Engineer' END AS contact_title, CAST(o_orderdate AS DATE) AS fetched_on FROM orders")
    out = M.fresh_matches(S.jobs(t), t.companies, t.roles, contacts, RADAR_DAY, 60, 30, "python|sql|skill1")
    return out.withColumn("known_recruiters", F.array_join(F.transform("known_recruiters", lambda c: c["name"]), ",")).drop("company_id")


@query("bi_32_ops_inventory", f"WITH {S.PAY} SELECT ingestion_source AS source, count(*) AS public_jobs, count(*) FILTER (WHERE salary_min_annual IS NOT NULL OR salary_max_annual IS NOT NULL) AS priced_jobs, count(*) FILTER (WHERE posted_date >= DATE '{RADAR_DAY}' - 1) AS new_24h, count(*) FILTER (WHERE experience_level IS NULL) AS missing_level, count(*) FILTER (WHERE workplace_type IS NULL) AS missing_workplace, max(last_seen_at) AS last_seen, {r('count(*) FILTER (WHERE salary_min_annual IS NOT NULL OR salary_max_annual IS NOT NULL) * 100.0 / count(*)', 1)} AS salary_pct FROM jobs WHERE is_public GROUP BY 1")
def _(t):
    return O.ops_inventory(S.jobs(t), RADAR_DAY)


TF = "tf AS (SELECT source, count(*) FILTER (WHERE status NOT IN ('complete_nonzero', 'complete_zero')) AS failed_tenants FROM (SELECT *, row_number() OVER (PARTITION BY source, crawl_tenant ORDER BY started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1 GROUP BY 1)"
ROLL = TF + """, bd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checkpoint_sweep DESC, started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1),
tot AS (SELECT source, CAST(sum(jobs_fetched) AS BIGINT) AS fetched, CAST(sum(jobs_written) AS BIGINT) AS written, bool_and(status IN ('complete_nonzero', 'complete_zero')) AS all_clean FROM f_tenant_runs GROUP BY 1),
roll AS (SELECT source, fetched, written, all_clean, coalesce(failed_tenants, 0) AS failed_tenants, CASE WHEN finished_on IS NULL THEN 'running' WHEN errors > 0 OR crawl_status NOT IN ('complete_nonzero', 'complete_zero') THEN 'source_failure'
 WHEN coalesce(failed_tenants, 0) > 0 THEN 'partial_failure' ELSE crawl_status END AS state FROM tot JOIN bd USING (source) LEFT JOIN tf USING (source))"""


@query("bi_32_crawl_rollup", f"WITH {ROLL} SELECT * FROM roll")
def _(t):
    return O.crawl_rollup(t.tenant_runs)


@query("bi_32_brief_rollup", f"""
WITH newest AS (SELECT orchestration_id FROM f_tenant_runs WHERE orchestration_id IS NOT NULL ORDER BY started_on DESC, run_id DESC LIMIT 1),
runs AS (SELECT * FROM f_tenant_runs WHERE orchestration_id = (SELECT orchestration_id FROM newest)),
{ROLL.replace('f_tenant_runs', 'runs').replace("WHEN coalesce(failed_tenants, 0) > 0", "WHEN degraded OR coalesce(failed_tenants, 0) > 0")} SELECT * FROM roll""")
def _(t):
    return O.crawl_rollup(O.latest_orchestration(t.tenant_runs), degraded="degraded")


# The report over all sources, over each source, and over none, at four ages of the publication.
@query("qlt_7_report_state", f"""
WITH {ROLL},
s AS (SELECT 'all' AS scope, state FROM roll UNION ALL SELECT source, state FROM roll),
c AS (SELECT scope, count(*) FILTER (WHERE state IN ('source_failure', 'partial_failure')) AS bad_sources, count(*) FILTER (WHERE state = 'running') AS running_sources FROM s GROUP BY 1 UNION ALL SELECT 'none', 0, 0),
h(hours) AS (VALUES (1), (36), (37), (47))
SELECT scope, hours, bad_sources, running_sources,
       CASE WHEN hours > 36 OR bad_sources > 0 THEN 'Needs attention' WHEN running_sources > 0 THEN 'In progress' ELSE 'Healthy' END AS state
FROM h, c""")
def _(t):
    rolled = O.crawl_rollup(t.tenant_runs)
    scoped = cut_lineage(rolled.select(F.explode(F.array(F.lit("all"), "source")).alias("scope"), "state"))
    parts = []
    for hours in (1, 36, 37, 47):
        published = F.lit(f"{RADAR_DAY} 00:00:00").cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
        now = f"{RADAR_DAY} 00:00:00"
        none = O.report_state(scoped.filter(F.lit(False)), published, now).withColumn("scope", F.lit("none"))
        parts += [r.withColumn("hours", F.lit(hours)) for r in (O.report_state(scoped, published, now, by=["scope"]), none)]
    return reduce(DataFrame.unionByName, parts).select("scope", "hours", "bad_sources", "running_sources", "state")


@query("bi_33_health_alerts", """
WITH h AS (SELECT count(*) AS host_attempts, count(*) FILTER (WHERE status = 'failed') AS host_failures, count(*) FILTER (WHERE started_on > DATE '2001-07-01') AS recent_attempts,
                  count(*) FILTER (WHERE started_on > DATE '2001-07-01' AND status IN ('failed', 'partial_failure')) AS recent_failures FROM f_tenant_runs),
q AS (SELECT concat('queue', alert_id % 4) AS queue, min(CASE WHEN alert_id % 4 = 3 THEN DATE '2001-11-30' ELSE signal_date END) AS oldest FROM f_alerts WHERE NOT delivered GROUP BY 1)
SELECT 'published inventory is over 36 hours old' AS alert WHERE (SELECT DATE '2001-12-01' - max(posted_date) FROM f_postings) * 24 > 36
UNION ALL SELECT concat(queue, ' notification backlog exceeds 7 days') FROM q WHERE DATE '2001-12-01' - oldest > 7
UNION ALL SELECT 'all direct-host attempts failed' FROM h WHERE host_attempts > 0 AND host_failures = host_attempts
UNION ALL SELECT 'direct-host failure rate is at least 50%' FROM h WHERE recent_attempts >= 5 AND recent_failures >= recent_attempts * 0.5
UNION ALL SELECT 'resume retention overdue' WHERE (SELECT count(*) FROM f_signups WHERE signed_up_on < DATE '2001-11-01') > 0""")
def _(t):
    today = F.lit(AS_OF).cast("date")
    recent = F.col("started_on") > F.lit("2001-07-01").cast("date")
    facts = t.tenant_runs.agg(
        F.count(F.lit(1)).alias("host_attempts"), F.count_if(F.col("status") == "failed").alias("host_failures"),
        F.count_if(recent).alias("recent_attempts"), F.count_if(recent & F.col("status").isin("failed", "partial_failure")).alias("recent_failures"))
    facts = facts.withColumns({
        "publication_age_hours": t.postings.agg((F.datediff(today, F.max("posted_date")) * 24).alias("h")).scalar(),
        "expired_resumes": t.view("signups").filter(F.col("signed_up_on") < F.lit("2001-11-01").cast("date")).agg(F.count(F.lit(1)).alias("n")).scalar()})
    number = F.col("alert_id") % 4
    queues = t.view("alerts").filter("NOT delivered").select(F.concat(F.lit("queue"), number.cast("string")).alias("queue"), F.when(number == 3, F.lit("2001-11-30").cast("date")).otherwise(F.col("signal_date")).alias("pending_since"))
    return O.health_alerts(facts, queues, AS_OF)


@query("bi_34_discovery_funnel", f"SELECT platform, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'unreachable') AS unreachable, count(*) FILTER (WHERE status = 'integrated') AS integrated, {r('''count(*) FILTER (WHERE status = 'active') * 100.0 / count(*)''', 0)} AS pct_active, count(*) FILTER (WHERE status = 'pending') > 5000 AS high_pending, count(*) FILTER (WHERE status = 'active') > 0 AND count(*) FILTER (WHERE status = 'unreachable') > count(*) FILTER (WHERE status = 'active') * 0.5 AS high_unreachable FROM f_candidates GROUP BY 1")
def _(t):
    return O.discovery_funnel(t.view("candidates"), ["pending", "active", "unreachable", "integrated"])


@query("bi_34_recent_yield", f"SELECT ingestion_source, count(DISTINCT job_id) AS jobs_7d FROM f_postings p WHERE last_seen_at >= DATE '{RADAR_DAY}' - 7 AND EXISTS (SELECT 1 FROM f_registry g WHERE g.source = p.ingestion_source AND CASE WHEN g.source = 'workday' THEN split_part(board_token, '/', 1) ELSE board_token END = p.crawl_tenant) GROUP BY 1")
def _(t):
    return O.recent_yield(t.postings, t.view("registry"), RADAR_DAY)


@query("bi_35_tenant_staleness", f"WITH o AS (SELECT crawl_tenant, max(last_seen_at) AS posting_seen FROM f_postings WHERE ingestion_source = 'workday' GROUP BY 1), g AS (SELECT crawl_tenant, max(registry_seen) AS registry_seen FROM f_registry WHERE source = 'workday' GROUP BY 1) SELECT crawl_tenant, greatest(registry_seen, posting_seen) AS last_seen, DATE '{RADAR_DAY}' - greatest(registry_seen, posting_seen) AS idle_days, coalesce(DATE '{RADAR_DAY}' - greatest(registry_seen, posting_seen) > 30, true) AS is_stale FROM g FULL JOIN o USING (crawl_tenant)")
def _(t):
    seen = t.postings.filter(F.col("ingestion_source") == "workday").groupBy("crawl_tenant").agg(F.max("last_seen_at").alias("posting_seen"))
    reg = t.view("registry").filter(F.col("source") == "workday").groupBy("crawl_tenant").agg(F.max("registry_seen").alias("registry_seen"))
    return O.tenant_staleness(reg, seen, RADAR_DAY)


@query("bi_36_employer_leads", "WITH a AS (SELECT company_id, count(*) FILTER (WHERE data_tier = 2 AND status = 'raw') AS tier2_jobs, count(*) FILTER (WHERE data_tier = 1) AS historical_tier1, count(*) FILTER (WHERE data_tier = 1 AND is_public) AS current_public, max(last_seen_at) AS last_seen FROM f_postings WHERE domain IS NOT NULL OR scope_status LIKE 'accepted%' GROUP BY 1) SELECT a.*, company_name FROM a JOIN f_companies USING (company_id) WHERE tier2_jobs > 0 OR (historical_tier1 > 0 AND current_public = 0) ORDER BY CASE WHEN tier2_jobs > 0 AND historical_tier1 = 0 THEN 0 ELSE 1 END, greatest(tier2_jobs, historical_tier1) DESC, last_seen DESC, company_id LIMIT 100")
def _(t):
    return O.employer_leads(t.postings, t.companies, 100)


@query("bi_37_integrate_candidates", """WITH x AS (SELECT *, CASE WHEN platform = 'workday' THEN CASE WHEN server IS NOT NULL THEN concat(tenant, '/', split_part(server, '/', 1), '/', CASE WHEN split_part(server, '/', 2) = '' THEN 'External' ELSE split_part(server, '/', 2) END) END
 WHEN platform = 'eightfold' THEN CASE WHEN server IS NOT NULL THEN concat(tenant, '/', server) END WHEN platform = 'oracle_cloud' THEN NULL ELSE tenant END AS board_token FROM f_candidates WHERE status = 'active')
SELECT platform, tenant, board_token, CASE WHEN platform = 'oracle_cloud' THEN 'needs_career_host' WHEN board_token IS NULL THEN 'no_server' END AS skip_reason, coalesce(nullif(trim(company_name), ''), concat('Tenant ', substring(tenant, 8))) AS company_name,
 CASE WHEN board_token IS NOT NULL THEN concat('AT', substring(md5(concat(platform, '|', board_token)), 1, 10)) END AS registry_id FROM x""")
def _(t):
    return O.integrate_candidates(t.view("candidates"))


@query("bi_38_eligible_reminders", "SELECT application_id, user_id, job_id, applied_on, outcome, reminded_on, email FROM (SELECT a.*, u.email, row_number() OVER (PARTITION BY a.user_id ORDER BY applied_on, application_id) AS rn FROM f_applications a JOIN f_users u USING (user_id) WHERE applied_on BETWEEN DATE '2001-08-01' - 21 AND DATE '2001-08-01' - 7 AND outcome IS NULL AND reminded_on IS NULL AND u.active AND u.email IS NOT NULL AND coalesce(email_enabled, true) AND NOT EXISTS (SELECT 1 FROM f_applications z WHERE z.user_id = a.user_id AND z.reminded_on > DATE '2001-08-01' - 7)) q WHERE rn = 1")
def _(t):
    return O.eligible_reminders(t.view("applications"), t.view("users"), RADAR_DAY)


@query("bi_38_eligible_nurture", "SELECT signup_id, email, signed_up_on FROM f_signups WHERE signed_up_on < DATE '2001-07-20' - 3 AND signed_up_on > DATE '2001-07-20' - 7 AND upgraded_on IS NULL AND last_seen_on IS NOT NULL AND nurtured_on IS NULL AND email LIKE '%@%' AND email NOT LIKE '%@test.%'")
def _(t):
    return O.eligible_nurture(t.view("signups"), "2001-07-20").select("signup_id", "email", "signed_up_on")


@query("bi_39_host_report", "SELECT platform, status, count(*) AS hosts, CAST(sum(last_job_count) AS BIGINT) AS jobs, (SELECT count(*) FROM f_postings WHERE is_public) AS visible_jobs, greatest(0, 100000 - (SELECT count(*) FROM f_postings WHERE is_public)) AS gap_to_target FROM f_hosts GROUP BY 1, 2")
def _(t):
    return O.host_report(t.view("hosts"), t.postings.filter("is_public"))


@query("bi_39_candidates", "SELECT status, count(*) AS candidates FROM f_candidates GROUP BY 1")
def _(t):
    return O.candidates_by_status(t.view("candidates"))


@query("bi_39_last_7_days", f"SELECT count(*) AS runs, coalesce(sum(accepted_jobs), 0) AS accepted, coalesce(sum(identity_mismatches), 0) AS identity_mismatches, coalesce(sum(foreign_rejections), 0) AS foreign_rejections FROM f_host_runs WHERE started_on >= DATE '{RADAR_DAY}' - 7 AND started_on <= DATE '{RADAR_DAY}'")
def _(t):
    return O.host_runs_total(t.view("host_runs"), RADAR_DAY)


@query("bi_40_product_funnel", "SELECT event_type, count(DISTINCT user_id) AS accounts FROM events WHERE CAST(ts AS DATE) > DATE '2024-02-10' - 30 GROUP BY 1")
def _(t):
    return O.product_funnel(t.base("events"), "2024-02-10")


BOARDS = """boards AS (
  SELECT g.source, g.crawl_tenant, g.board_token, g.registry_seen, count(p.job_id) AS active_roles
  FROM f_registry g LEFT JOIN f_postings p ON p.ingestion_source = g.source AND p.status = 'raw' AND p.crawl_tenant = CASE WHEN g.source = 'workday' THEN split_part(g.board_token, '/', 1) ELSE g.board_token END
  GROUP BY 1, 2, 3, 4)"""


@query("bi_41_refresh_registry", f"WITH {BOARDS} SELECT * FROM boards")
def _(t):
    return O.refresh_registry(t.view("registry"), t.postings)


@query("bi_41_registry_summary", f"WITH {BOARDS} SELECT source, count(*) AS boards, count(*) FILTER (WHERE active_roles > 0) AS with_roles, CAST(sum(active_roles) AS BIGINT) AS open_roles FROM boards GROUP BY 1")
def _(t):
    return O.registry_summary(O.refresh_registry(t.view("registry"), t.postings))
