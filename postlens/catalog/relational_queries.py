"""Projections, filters, joins, aggregates, windows, sorting and generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import columns as C
from ..operators import filters as P
from ..operators import relational as R
from ..plans import core
from . import shared as S
from .registry import query, r

MAJOR = ", ".join(f"'{code}'" for code in C.US_STATES)
US_PLACE = f"""((loc_country IN ('US','United States','USA') AND (loc_state IS NULL OR upper(loc_state) IN ({MAJOR})))
 OR (loc_country IS NULL AND upper(coalesce(loc_state,'')) IN ({MAJOR}))
 OR (loc_country = 'unknown' AND ingestion_source IN ('greenhouse','lever','ashby'))
 OR (loc_country = 'unknown' AND ingestion_source = 'workday' AND workplace_type = 'remote'))"""
FEED = f"""feed AS (SELECT j.*, c.company_name, c.company_slug, c.sector FROM jobs j JOIN f_companies c USING (company_id)
 WHERE data_tier = 1 AND is_public AND domain IS NOT NULL AND (loc_country IS NULL OR loc_country <> 'foreign') AND {US_PLACE}
 AND lower(company_name) NOT LIKE '%firm 77%' AND lower(company_name) NOT LIKE '%firm 5 inc%' AND lower(company_name) NOT LIKE '%firm 41 %')"""


def feed(t):
    return P.public_feed(S.jobs(t), t.companies, S.EXCLUSIONS)


# ---- projections -------------------------------------------------------------------------

@query("src_1_entity_scan", "SELECT n_name, r_name, count(*) AS customers, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_credit FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def _(t):
    from ..sources.entities import read_entities

    e = read_entities(t.spark, t.root)
    return (
        e["customer"].join(e["nation"], F.col("n_nationkey") == F.col("c_nationkey")).join(e["region"], F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"))
    )


# Every entity by its declared schema: rows, and how many have a value in the last column declared.
ENTITY_ENDS = {"region": "r_name", "nation": "n_regionkey", "customer": "c_mktsegment", "supplier": "s_acctbal", "part": "p_retailprice", "orders": "o_orderpriority", "lineitem": "l_shipdate", "events": "props",
               "documents": "n_chars", "embeddings": "label", "pages": "html", "benchmark": "text", "labels": "toxic", "conversations": "text"}


@query("src_1_all_entities", " UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS n, count({c}) AS filled FROM {e}" for e, c in ENTITY_ENDS.items()))
def _(t):
    from ..sources.entities import SCHEMAS, read_entities

    counted = [df.agg(F.count(F.lit(1)).alias("n"), F.count(SCHEMAS[name].rsplit(", ", 1)[-1].split()[0]).alias("filled")).select(F.lit(name).alias("entity"), "n", "filled") for name, df in read_entities(t.spark, t.root).items()]
    return reduce(DataFrame.unionByName, counted)


@query("prj_1_stage_dims", "SELECT company_id, trim(company_name) AS company_name, nullif(trim(company_type), '') AS company_type FROM f_companies")
def _(t):
    return C.stage_dim(t.companies, ["company_name", "company_type"]).select("company_id", "company_name", "company_type")


@query("prj_2_canonicalize_pay", f"WITH {S.PAY} SELECT job_id, pay_period, CASE per WHEN 'hour' THEN true WHEN 'year' THEN false END AS is_hourly, CAST(salary_min AS DOUBLE) AS pay_min_raw, CAST(salary_max AS DOUBLE) AS pay_max_raw, 2080 AS annualization_hours, CAST(salary_min_annual AS DOUBLE) AS salary_min_annual, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual FROM jobs")
def _(t):
    return C.canonicalize_pay(t.postings).select("job_id", "pay_period", "is_hourly", "pay_min_raw", "pay_max_raw",
                                                 "annualization_hours", "salary_min_annual", "salary_max_annual")


@query("prj_3_tier_default", "SELECT ingestion_source, coalesce(data_tier_raw, CASE WHEN ingestion_source = 'adzuna' THEN 2 ELSE 1 END) AS tier, count(*) AS n FROM f_postings GROUP BY 1, 2")
def _(t):
    return t.postings.groupBy("ingestion_source", C.tier_or_default(F.col("data_tier_raw"), F.col("ingestion_source")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_4_annualize", "WITH a AS (SELECT job_id, salary_max * CASE lower(trim(salary_period)) WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'hour' THEN 2080 END AS v FROM f_postings) SELECT job_id, CASE WHEN v BETWEEN 15000 AND 1000000 THEN v END AS annual FROM a")
def _(t):
    return t.postings.select("job_id", C.annualize(F.col("salary_max"), F.lower(F.trim("salary_period"))).alias("annual"))


@query("prj_5_salary_midpoint", "SELECT job_id, coalesce((salary_min + salary_max) / 2, salary_min, salary_max) AS midpoint FROM f_postings")
def _(t):
    return t.postings.select("job_id", C.salary_midpoint(F.col("salary_min"), F.col("salary_max")).alias("midpoint"))


@query("prj_6_days_open", f"SELECT job_id, CASE status WHEN 'raw' THEN DATE '{AS_OF}' - posted_date ELSE last_seen_at - posted_date END AS days_open, last_seen_at - ingested_at AS days_tracked FROM f_postings")
def _(t):
    return C.days_open(t.postings, AS_OF).select("job_id", "days_open", "days_tracked")


@query("prj_7_dim_companies", f"WITH {S.DIMS} SELECT * FROM dims")
def _(t):
    return S.dims(t)


FAMILY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(role_name), '{p}') THEN '{n}'" for n, p in S.FAMILIES) + " ELSE 'Other' END"


@query("prj_8_role_family", f"SELECT {FAMILY_SQL} AS role_family, count(*) AS n FROM f_roles GROUP BY 1")
def _(t):
    return t.roles.groupBy(C.role_family(F.col("role_name"), S.FAMILIES).alias("role_family")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_9_md5_id", "SELECT role_id, concat('R', substring(md5(concat_ws('|', role_id, role_name)), 1, 10)) AS sid FROM f_roles")
def _(t):
    return t.roles.select("role_id", C.md5_id("R", F.col("role_id"), F.col("role_name")).alias("sid"))


@query("prj_10_slug", "SELECT doc_id, substring(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM documents")
def _(t):
    return t.base("documents").select("doc_id", C.slug(F.col("text")).alias("slug"))


@query("prj_11_employment_type", """SELECT job_id, CASE kind WHEN 'Full-Time' THEN 'full-time' WHEN 'PART_TIME' THEN 'part-time' WHEN ' Contractor' THEN 'contract' WHEN 'intern' THEN 'internship' END AS employment_type
 FROM (SELECT job_id, CASE life_days % 5 WHEN 0 THEN 'Full-Time' WHEN 1 THEN 'PART_TIME' WHEN 2 THEN ' Contractor' WHEN 3 THEN 'intern' ELSE 'Gig' END AS kind FROM f_postings) s""")
def _(t):
    kind = F.expr("CASE life_days % 5 WHEN 0 THEN 'Full-Time' WHEN 1 THEN 'PART_TIME' WHEN 2 THEN ' Contractor' WHEN 3 THEN 'intern' ELSE 'Gig' END")
    return t.postings.select("job_id", C.normalize_employment_type(kind).alias("employment_type"))


DATE_FORMS = "CASE life_days % 6 WHEN 0 THEN cast(posted_date AS STRING) WHEN 1 THEN concat(cast(posted_date AS STRING), 'T10:00:00Z') WHEN 2 THEN 'soon' WHEN 3 THEN '2026-02-30' WHEN 4 THEN NULL ELSE 'January 2, 2001' END"


@query("prj_12_parse_dates", "SELECT job_id, CASE life_days % 6 WHEN 0 THEN posted_date WHEN 1 THEN posted_date WHEN 5 THEN DATE '2001-01-02' END AS parsed, CAST(DATE '2001-12-01' - life_days AS DATE) AS relative FROM f_postings")
def _(t):
    return t.postings.select("job_id", C.parse_posted_date(F.expr(DATE_FORMS)).alias("parsed"),
                             C.parse_relative_date(F.concat(F.col("life_days").cast("string"), F.lit(" days ago")), AS_OF).alias("relative"))


# ---- filters -----------------------------------------------------------------------------

@query("flt_1_public_feed", f"WITH {S.PAY}, {FEED} SELECT job_id, company_name, domain, loc_state FROM feed")
def _(t):
    return feed(t).select("job_id", "company_name", "domain", "loc_state")


@query("flt_2_exclusions", "SELECT company_id, company_name FROM f_companies WHERE NOT (lower(trim(company_name)) = 'firm 5 inc' OR lower(company_name) LIKE '%firm 77%' OR lower(company_name) LIKE '%firm 41 %')")
def _(t):
    return P.apply_exclusions(t.companies, "company_name", S.EXCLUSIONS).select("company_id", "company_name")


@query("flt_3_placeholders", "SELECT job_id, role_name FROM f_postings p LEFT JOIN f_roles USING (role_id) LEFT JOIN f_companies USING (company_id) WHERE NOT coalesce(regexp_matches(role_name, '(?i)talent (pool|community|network)'), false) AND NOT regexp_matches(description_text, '(?i)not currently hiring')")
def _(t):
    wide = t.postings.join(t.roles, "role_id", "left").join(t.companies.select("company_id", "company_name"), "company_id", "left")
    return P.drop_placeholders(wide).select("job_id", "role_name")


@query("flt_4_title_filter", "SELECT role_id, CASE WHEN regexp_matches(lower(role_name), 'nurse|teacher') THEN 'deny:clinical' WHEN regexp_matches(lower(role_name), 'talent') THEN 'deny:pool' WHEN regexp_matches(lower(role_name), 'data|analy') THEN 'allow:data' WHEN regexp_matches(lower(role_name), 'engineer') THEN 'allow:engineer' ELSE 'deny:no_match' END AS title_reason, regexp_matches(lower(role_name), 'data|analy|engineer') AND NOT regexp_matches(lower(role_name), 'nurse|teacher|talent') AS title_kept FROM f_roles")
def _(t):
    return P.title_filter(t.roles, "role_name", [("clinical", "nurse|teacher"), ("pool", "talent")], [("data", "data|analy"), ("engineer", "engineer")]).drop("role_name")


@query("flt_5_skill_presence", "SELECT p.status AS old_status, CASE WHEN j.job_id IS NULL THEN 'ignored' ELSE p.status END AS status, count(*) AS n FROM f_postings p LEFT JOIN (SELECT DISTINCT job_id FROM f_job_skills) j USING (job_id) GROUP BY 1, 2")
def _(t):
    out = P.skill_presence_filter(t.postings.withColumn("old_status", F.col("status")), t.job_skills)
    return out.groupBy("old_status", "status").agg(F.count(F.lit(1)).alias("n"))


@query("flt_6_blocklist", "SELECT company_name, count(*) AS blocked_postings FROM f_postings JOIN f_companies USING (company_id) WHERE status = 'raw' AND lower(company_name) IN ('firm 3 inc', 'firm 12 inc.', 'firm 40 inc') GROUP BY 1")
def _(t):
    return P.enforce_blocklist(t.postings, t.companies, ["Firm 3 Inc", "Firm 12 inc.", "Firm 40 INC"])


def _search_base(t):
    return (
        S.jobs(t).filter((F.col("data_tier") == 1) & F.col("is_public") & F.coalesce("loc_country", F.lit("unknown")).isin("US", "unknown"))
        .join(t.roles, "role_id").join(t.companies.select("company_id", "company_name", "sector"), "company_id", "left")
        .withColumn("role_family", C.role_family(F.col("role_name"), S.FAMILIES))
    )


SEARCH = f"WITH {S.PAY}, s AS (SELECT j.*, role_name, {FAMILY_SQL} AS role_family FROM jobs j JOIN f_roles USING (role_id) WHERE data_tier = 1 AND is_public AND coalesce(loc_country, 'unknown') IN ('US', 'unknown'))"


@query("flt_7_search_roles", SEARCH + ", h AS (SELECT * FROM s WHERE workplace_type = 'remote' AND salary_max_annual >= 90000) SELECT (SELECT count(*) FROM h) AS total, job_id, role_name, role_family, CAST(salary_max_annual AS DOUBLE) AS salary_max_annual, posted_date FROM h ORDER BY ingested_at DESC, job_id LIMIT 50 OFFSET 10")
def _(t):
    total, page = P.search_roles(_search_base(t), {"remote": True, "min_salary": 90_000, "family": None},
                                 [F.col("ingested_at").desc(), F.col("job_id")], 50, 10)
    return page.select(total.scalar().alias("total"), "job_id", "role_name", "role_family", "salary_max_annual", "posted_date")


@query("flt_8_sample_rows", "SELECT job_id, status FROM f_postings ORDER BY md5(concat_ws('|', job_id, '7')), job_id LIMIT 40")
def _(t):
    return R.sample_rows(t.postings, "job_id", 40, seed=7).select("job_id", "status")


# ---- joins -------------------------------------------------------------------------------

@query("jn_1_inner_bridge", "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, skill_id ORDER BY confidence DESC NULLS LAST, job_skills_id) AS rn FROM f_job_skills) q WHERE rn = 1) SELECT job_skills_id, job_id, skill_id, skill_name, lower(skill_priority) AS skill_priority, confidence FROM s JOIN f_skills USING (skill_id)")
def _(t):
    return core.bridge_job_skills(t.job_skills, t.skills).select("job_skills_id", "job_id", "skill_id", "skill_name", "skill_priority", "confidence")


@query("jn_2_left_enrich", "SELECT p.job_id, c.sector, r.role_name FROM f_postings p LEFT JOIN f_companies c USING (company_id) LEFT JOIN f_roles r USING (role_id)")
def _(t):
    return t.postings.select("job_id", "company_id", "role_id").join(t.companies.select("company_id", "sector"), "company_id", "left").join(t.roles, "role_id", "left").select("job_id", "sector", "role_name")


@query("jn_3_case_folded", "SELECT a.company_id, b.company_id AS other_id FROM f_companies a JOIN f_companies b ON lower(replace(a.company_name, '.', '')) = lower(replace(b.company_name, '.', '')) AND a.company_id < b.company_id")
def _(t):
    key = F.lower(F.replace(F.col("company_name"), F.lit("."), F.lit("")))
    a = t.companies.select("company_id", key.alias("k"))
    b = t.companies.select(F.col("company_id").alias("other_id"), key.alias("k"))
    return a.join(b, "k").filter(F.col("company_id") < F.col("other_id")).drop("k")


@query("jn_4_one_row_aggregate", f"WITH m AS (SELECT avg(salary_max) AS a FROM f_postings WHERE salary_max BETWEEN 50000 AND 500000) SELECT job_id, {r('salary_max / m.a', 4)} AS vs_market FROM f_postings, m WHERE salary_max BETWEEN 50000 AND 500000")
def _(t):
    band = t.postings.filter(F.col("salary_max").between(50_000, 500_000))
    avg = band.agg(F.avg("salary_max").alias("a"))
    return band.select("job_id", C.rounded(F.col("salary_max") / avg.scalar(), 4).alias("vs_market"))


@query("jn_5_fallback_cascade", f"WITH {S.RISK} SELECT job_id, baseline_type, {r('base', 0)} AS baseline_days FROM risk")
def _(t):
    return S.risk(t).select("job_id", "baseline_type", "baseline_days")


@query("jn_6_latest_before", f"WITH {S.REPOSTS} SELECT event_id, job_id, observed_at, gone_at AS prior_observed_at FROM back")
def _(t):
    log = t.posting_events.filter(F.col("event_type").isin("disappeared", "reappeared"))
    out = R.latest_before(log, "job_id", "observed_at", F.col("event_type") == "disappeared", ["posted_date"], F.date_trunc("week", F.col("observed_at").cast("timestamp")))
    return out.filter((F.col("event_type") == "reappeared") & F.col("prior_observed_at").isNotNull()).select("event_id", "job_id", "observed_at", "prior_observed_at")


@query("jn_7_semi", "SELECT job_id FROM f_postings p WHERE EXISTS (SELECT 1 FROM f_job_skills j WHERE j.job_id = p.job_id AND j.skill_priority = 'required')")
def _(t):
    return t.postings.join(t.job_skills.filter(F.col("skill_priority") == "required"), "job_id", "left_semi").select("job_id")


@query("jn_8_anti", "SELECT job_id FROM f_postings p WHERE NOT EXISTS (SELECT 1 FROM f_job_skills j WHERE j.job_id = p.job_id)")
def _(t):
    return t.postings.join(t.job_skills, "job_id", "left_anti").select("job_id")


@query("jn_10_substring_anti", "SELECT company_id FROM f_companies WHERE NOT (lower(company_name) LIKE '%firm 1%' OR lower(company_name) LIKE '%9 inc.%')")
def _(t):
    return P.apply_exclusions(t.companies, "company_name", [("firm 1", "substring"), ("9 inc.", "substring")]).select("company_id")


@query("jn_11_lagged_self_join", "WITH d AS (SELECT ingestion_source, posted_date AS day, count(*) AS n FROM f_postings GROUP BY 1, 2) SELECT c.ingestion_source, c.day, c.n, p.n AS n_week_before FROM d c JOIN d p ON p.ingestion_source = c.ingestion_source AND p.day = c.day - 7")
def _(t):
    d = t.postings.groupBy("ingestion_source", F.col("posted_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    prior = d.select("ingestion_source", F.date_add("day", 7).alias("day"), F.col("n").alias("n_week_before"))
    return d.join(prior, ["ingestion_source", "day"])


@query("jn_12_null_safe", "WITH a AS (SELECT experience_level, count(*) AS n FROM f_postings WHERE is_public GROUP BY 1), b AS (SELECT experience_level, count(*) AS m FROM f_postings WHERE NOT is_public GROUP BY 1) SELECT a.experience_level, n, m FROM a JOIN b ON a.experience_level IS NOT DISTINCT FROM b.experience_level")
def _(t):
    a = t.postings.filter("is_public").groupBy("experience_level").agg(F.count(F.lit(1)).alias("n"))
    b = t.postings.filter("NOT is_public").groupBy(F.col("experience_level").alias("lv")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, F.col("experience_level").eqNullSafe(F.col("lv"))).drop("lv")


@query("jn_13_array_membership", "WITH d AS (SELECT DISTINCT unnest([c_custkey * 2, c_custkey * 3]) AS k FROM customer) SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k = o_orderkey)")
def _(t):
    sent = t.base("customer").select(F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 3)).alias("o_orderkey"))
    return t.base("orders").join(sent, "o_orderkey", "left_anti").select("o_orderkey")


@query("jn_14_lateral_labels", "SELECT label, count(*) AS n FROM (SELECT unnest([CASE WHEN workplace_type = 'remote' THEN 'remote' END, CASE WHEN upper(loc_state) = 'WA' THEN 'wa' END, CASE WHEN loc_country = 'US' THEN 'us' END]) AS label FROM f_postings) s WHERE label IS NOT NULL GROUP BY 1")
def _(t):
    labels = F.array_compact(F.array(F.when(F.col("workplace_type") == "remote", F.lit("remote")),
                                     F.when(F.upper("loc_state") == "WA", F.lit("wa")), F.when(F.col("loc_country") == "US", F.lit("us"))))
    return t.postings.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates --------------------------------------------------------------------------

@query("ag_1_conditional", "SELECT ingestion_source, count(*) FILTER (WHERE status = 'raw') AS active, count(*) FILTER (WHERE is_public AND domain IS NULL) AS unresolved FROM f_postings GROUP BY 1")
def _(t):
    return t.postings.groupBy("ingestion_source").agg(F.count_if(F.col("status") == "raw").alias("active"), F.count_if(F.col("is_public") & F.col("domain").isNull()).alias("unresolved"))


@query("ag_2_count_distinct", "SELECT ingestion_source, count(DISTINCT company_id) AS companies, count(DISTINCT company_id) FILTER (WHERE is_public) AS public_companies FROM f_postings GROUP BY 1")
def _(t):
    return t.postings.groupBy("ingestion_source").agg(F.countDistinct("company_id").alias("companies"), F.countDistinct(F.when(F.col("is_public"), F.col("company_id"))).alias("public_companies"))


@query("ag_3_percentiles", f"WITH {S.PAY} SELECT ingestion_source, {r('quantile_cont(salary_max_annual, 0.25) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000)', 0)} AS p25, {r('quantile_cont(salary_max_annual, 0.5) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000)', 0)} AS p50, {r('quantile_cont(salary_max_annual, 0.75) FILTER (WHERE salary_max_annual BETWEEN 50000 AND 500000)', 0)} AS p75 FROM jobs GROUP BY 1")
def _(t):
    pay = core.in_band(F.col("salary_max_annual"))
    return S.jobs(t).groupBy("ingestion_source").agg(*[core.median(pay, p=p).alias(n) for n, p in (("p25", .25), ("p50", .5), ("p75", .75))])


@query("ag_4_mode", "WITH c AS (SELECT company_id, experience_level, count(*) AS n FROM f_postings WHERE experience_level IS NOT NULL GROUP BY 1, 2) SELECT company_id, experience_level AS primary_level FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, experience_level) AS rn FROM c) q WHERE rn = 1")
def _(t):
    return t.postings.filter(F.col("experience_level").isNotNull()).groupBy("company_id").agg(F.mode("experience_level", True).alias("primary_level"))


@query("ag_5_ordered_string_agg", "SELECT company_id, string_agg(domain, ', ' ORDER BY n DESC, domain) AS domains FROM (SELECT company_id, domain, count(*) AS n FROM f_postings WHERE domain IS NOT NULL GROUP BY 1, 2) s GROUP BY 1")
def _(t):
    counts = t.postings.filter(F.col("domain").isNotNull()).groupBy("company_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "domain"))).alias("d")).select(
        "company_id", F.array_join(F.transform("d", lambda x: x["domain"]), ", ").alias("domains"))


@query("ag_6_top_slice", "SELECT company_id, string_agg(job_id, ',' ORDER BY posted_date DESC, job_id) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY posted_date DESC, job_id) AS rn FROM f_postings) q WHERE rn <= 3 GROUP BY 1")
def _(t):
    # Rank first: the collected list then holds three rows per company at most.
    top = R.top_per_group(t.postings, ["company_id"], [F.col("posted_date").desc(), F.col("job_id")], 3, rank_as="place")
    return top.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("place", "job_id"))).alias("l")).select(
        "company_id", F.array_join(F.transform("l", lambda x: x["job_id"]), ",").alias("newest"))


@query("ag_7_distinct_array", "SELECT skill_id, string_agg(DISTINCT lower(skill_priority), ',' ORDER BY lower(skill_priority)) AS priorities FROM f_job_skills GROUP BY 1")
def _(t):
    return t.job_skills.groupBy("skill_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("skill_priority"))), ",").alias("priorities"))


@query("ag_8_bool_and_or", "SELECT source, bool_and(status IN ('complete_nonzero', 'complete_zero')) AS all_clean, bool_or(errors > 0) AS any_error FROM f_tenant_runs GROUP BY 1")
def _(t):
    return t.tenant_runs.groupBy("source").agg(F.bool_and(F.col("status").isin("complete_nonzero", "complete_zero")).alias("all_clean"), F.bool_or(F.col("errors") > 0).alias("any_error"))


@query("ag_9_min_sample", "SELECT company_id, count(*) AS n FROM f_postings GROUP BY 1 HAVING count(*) >= 12")
def _(t):
    return R.min_sample(t.postings.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")), 12, "n")


@query("ag_10_month_bucket", "SELECT CAST(date_trunc('month', posted_date) AS DATE) AS month, count(*) AS n FROM f_postings GROUP BY 1")
def _(t):
    return t.postings.groupBy(F.date_trunc("month", "posted_date").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("ag_11_scalar_denominator", f"SELECT ingestion_source, {r('count(*) * 100.0 / (SELECT count(*) FROM f_postings)', 2)} AS pct FROM f_postings GROUP BY 1")
def _(t):
    total = t.postings.agg(F.count(F.lit(1)).alias("n"))
    return t.postings.groupBy("ingestion_source").agg(F.count(F.lit(1)).alias("n")).select("ingestion_source", C.rounded(F.col("n") * 100.0 / total.scalar(), 2).alias("pct"))


@query("ag_12_majority_vote", "WITH c AS (SELECT company_id, loc_country, count(*) AS votes FROM f_postings GROUP BY 1, 2), x AS (SELECT *, sum(votes) OVER (PARTITION BY company_id) AS total FROM c) SELECT company_id, loc_country, votes, CAST(total AS BIGINT) AS total FROM x WHERE total >= 5 AND votes >= 0.6 * total")
def _(t):
    return R.majority_vote(t.postings, "company_id", "loc_country", min_share=0.6)


@query("ag_13_trimmed_mean", f"WITH x AS (SELECT company_id, salary_max AS v, row_number() OVER (PARTITION BY company_id ORDER BY salary_max) - 1 AS i, count(*) OVER (PARTITION BY company_id) AS n FROM f_postings WHERE salary_max IS NOT NULL) SELECT company_id, {r('avg(v)', 4)} AS trimmed_mean FROM x WHERE (floor(n * 0.9) > floor(n * 0.1) AND i >= floor(n * 0.1) AND i < floor(n * 0.9)) OR floor(n * 0.9) <= floor(n * 0.1) GROUP BY 1")
def _(t):
    return R.trimmed_mean(t.postings, ["company_id"], "salary_max").withColumn("trimmed_mean", C.rounded(F.col("trimmed_mean"), 4))


@query("ag_14_empirical_percentile", f"WITH x AS (SELECT job_id, ingestion_source, salary_max, cume_dist() OVER (PARTITION BY ingestion_source ORDER BY salary_max) AS c FROM f_postings WHERE salary_max IS NOT NULL) SELECT job_id, {r('c * 100', 2)} AS percentile FROM x")
def _(t):
    return R.empirical_percentile(t.postings.select("job_id", "ingestion_source", "salary_max").filter("salary_max IS NOT NULL"), ["ingestion_source"], "salary_max").select("job_id", "percentile")


# ---- windows -----------------------------------------------------------------------------

@query("wn_1_best_row", "SELECT job_skills_id, job_id, skill_id, lower(skill_priority) AS skill_priority, confidence FROM (SELECT *, row_number() OVER (PARTITION BY job_id, skill_id ORDER BY confidence DESC NULLS LAST, job_skills_id) AS rn FROM f_job_skills) q WHERE rn = 1")
def _(t):
    return core.stage_job_skills(t.job_skills).select("job_skills_id", "job_id", "skill_id", "skill_priority", "confidence")


@query("wn_2_cluster_representative", "SELECT canonical_opportunity_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_opportunity_id ORDER BY CASE ingestion_source WHEN 'greenhouse' THEN 0 WHEN 'ashby' THEN 1 WHEN 'lever' THEN 2 ELSE 7 END, length(description_text) DESC, posted_date DESC NULLS LAST, last_seen_at DESC NULLS LAST, job_id) AS rn FROM f_postings) q WHERE rn = 1")
def _(t):
    rank = F.when(F.col("ingestion_source") == "greenhouse", 0).when(F.col("ingestion_source") == "ashby", 1).when(F.col("ingestion_source") == "lever", 2).otherwise(7)
    # Rank on the length, so the texts themselves are not shuffled.
    slim = t.postings.select("canonical_opportunity_id", "job_id", "posted_date", "last_seen_at", rank.alias("src"), F.length("description_text").alias("len"))
    return R.dedupe_best(slim, ["canonical_opportunity_id"], [F.col("src"), F.col("len").desc(), F.col("posted_date").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), F.col("job_id")]).select("canonical_opportunity_id", "job_id")


@query("wn_3_latest_row", "SELECT source, crawl_tenant, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source, crawl_tenant ORDER BY started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1")
def _(t):
    return R.dedupe_best(t.tenant_runs, ["source", "crawl_tenant"], [F.col("started_on").desc(), F.col("run_id").desc()]).select("source", "crawl_tenant", "run_id", "status")


@query("wn_4_minmax_scale", f"WITH c AS (SELECT company_id, count(*) AS n FROM f_postings GROUP BY 1) SELECT company_id, {r('(n - (SELECT min(n) FROM c)) / nullif((SELECT max(n) FROM c) - (SELECT min(n) FROM c), 0) * 100', 1)} AS scaled FROM c")
def _(t):
    counts = t.postings.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return counts.withColumns({"lo": lo, "hi": hi}).select("company_id", C.rounded((F.col("n") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * 100, 1).alias("scaled"))


@query("wn_5_group_facts", "SELECT job_id, min(date_found) OVER w AS first_found, max(last_seen_at) OVER w AS last_seen, bool_or(is_public) OVER w AS any_public FROM f_postings WINDOW w AS (PARTITION BY company_id, canonical_opportunity_id)")
def _(t):
    p = t.postings.select("job_id", "company_id", "canonical_opportunity_id", "date_found", "last_seen_at", "is_public")
    return R.with_group_facts(p, ["company_id", "canonical_opportunity_id"], first_found=F.min("date_found"), last_seen=F.max("last_seen_at"), any_public=F.bool_or("is_public")).select("job_id", "first_found", "last_seen", "any_public")


@query("wn_6_cohort_size", "SELECT job_id, count(*) OVER (PARTITION BY company_id, posted_date) AS cohort FROM f_postings")
def _(t):
    return R.with_group_facts(t.postings.select("job_id", "company_id", "posted_date"), ["company_id", "posted_date"], cohort=F.count(F.lit(1))).select("job_id", "cohort")


@query("wn_7_top_k", "SELECT company_id, job_id, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY salary_max DESC NULLS LAST, job_id) AS rn FROM f_postings) q WHERE rn <= 5")
def _(t):
    return R.top_per_group(t.postings.select("company_id", "job_id", "salary_max"), ["company_id"], [F.col("salary_max").desc_nulls_last(), F.col("job_id")], 5, rank_as="place").drop("salary_max")


@query("wn_8_fair_interleave", "SELECT job_id, status, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY posted_date, job_id) AS rn FROM f_postings) q ORDER BY rn, CASE WHEN status = 'raw' THEN 0 ELSE 1 END, posted_date, job_id LIMIT 200")
def _(t):
    return R.fair_interleave(t.postings.select("job_id", "status", "posted_date"), "status", [F.col("posted_date"), F.col("job_id")], F.when(F.col("status") == "raw", 0).otherwise(1), 200).drop("posted_date")


# ---- sorting, set operations, generators ---------------------------------------------------

@query("st_1_top_k_nulls_last", "SELECT company_id, count(*) AS n, max(salary_max) AS top FROM f_postings GROUP BY 1 ORDER BY n DESC, top DESC NULLS LAST, company_id LIMIT 20")
def _(t):
    return t.postings.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.max("salary_max").alias("top")).orderBy(F.col("n").desc(), F.col("top").desc_nulls_last(), "company_id").limit(20)


def level_rank():
    return F.when(F.col("experience_level") == "entry", 1).when(F.col("experience_level") == "associate", 2).when(F.col("experience_level") == "mid", 3).when(F.col("experience_level") == "senior", 4).otherwise(5)


@query("st_2_enum_order", "SELECT job_id, experience_level FROM f_postings ORDER BY CASE experience_level WHEN 'entry' THEN 1 WHEN 'associate' THEN 2 WHEN 'mid' THEN 3 WHEN 'senior' THEN 4 ELSE 5 END, job_id LIMIT 100")
def _(t):
    return t.postings.select("job_id", "experience_level").orderBy(level_rank(), "job_id").limit(100)


@query("st_3_offset_page", "SELECT job_id, posted_date FROM f_postings ORDER BY posted_date DESC, job_id LIMIT 25 OFFSET 100")
def _(t):
    return t.postings.select("job_id", "posted_date").orderBy(F.col("posted_date").desc(), "job_id").offset(100).limit(25)


@query("so_1_scope_fan_out", "SELECT scope, count(*) AS n FROM (SELECT 'all' AS scope FROM f_postings WHERE domain IS NOT NULL UNION ALL SELECT domain FROM f_postings WHERE domain IS NOT NULL) s GROUP BY 1")
def _(t):
    return t.postings.filter(F.col("domain").isNotNull()).select(F.explode(F.array(F.lit("all"), F.col("domain"))).alias("scope")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("so_2_signal_branches", "SELECT 'no_pay' AS signal, job_id FROM f_postings WHERE salary_max IS NULL UNION ALL SELECT 'stale', job_id FROM f_postings WHERE life_days >= 90 UNION ALL SELECT 'no_domain', job_id FROM f_postings WHERE domain IS NULL")
def _(t):
    hits = F.array_compact(F.array(F.when(F.col("salary_max").isNull(), F.lit("no_pay")), F.when(F.col("life_days") >= 90, F.lit("stale")), F.when(F.col("domain").isNull(), F.lit("no_domain"))))
    return t.postings.select(F.explode(hits).alias("signal"), "job_id")


@query("so_3_set_difference", "WITH now_set AS (SELECT job_id FROM f_postings WHERE is_public), next_set AS (SELECT job_id FROM f_postings WHERE status = 'raw' AND domain IS NOT NULL) SELECT coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN b.job_id IS NULL THEN 'removed' WHEN a.job_id IS NULL THEN 'added' ELSE 'kept' END AS change FROM now_set a FULL JOIN next_set b ON a.job_id = b.job_id")
def _(t):
    # Both sets are predicates on one table: one scan, no join.
    old, new = F.col("is_public"), (F.col("status") == "raw") & F.col("domain").isNotNull()
    return t.postings.filter(old | new).select("job_id", F.when(old & new, "kept").when(old, "removed").otherwise("added").alias("change"))


@query("gn_1_day_series", "SELECT day, count(*) AS open_postings FROM (SELECT CAST(unnest(generate_series(greatest(posted_date, DATE '2001-06-01'), least(last_seen_at, DATE '2001-06-30'), INTERVAL 1 DAY)) AS DATE) AS day FROM f_postings WHERE posted_date <= DATE '2001-06-30' AND last_seen_at >= DATE '2001-06-01') s GROUP BY 1")
def _(t):
    first, last = F.lit("2001-06-01").cast("date"), F.lit("2001-06-30").cast("date")
    seen = t.postings.filter((F.col("posted_date") <= last) & (F.col("last_seen_at") >= first))
    days = F.sequence(F.greatest("posted_date", first), F.least("last_seen_at", last))
    return seen.select(F.explode(days).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("open_postings"))
