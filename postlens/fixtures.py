"""Posting-shaped views over the TPC-H-like test tables.

The text below is in the SQL that Spark and DuckDB share, so the very same views
feed the Spark queries and the checking SQL.  Everything is a per-row expression
over the whole base table: no filter, no sampling.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a test table out over the cores.

    The test tables are single files of one row group, which no reader setting can split;
    this is the fixture's business only, and no operator does it.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


AS_OF = "2001-12-01"       # stands in for "today" in every posting query
RADAR_DAY = "2001-08-01"   # a day inside the event timeline

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["f_companies"] = """
SELECT concat('C', c_custkey) AS company_id,
       concat('Firm ', CAST(floor(c_custkey / 2) AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN ' Inc' ELSE ' inc.' END) AS company_name,
       concat('firm-', c_custkey) AS company_slug,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS sector,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 100 + (c_custkey * 37) % 20000 END AS employee_count,
       CASE WHEN c_custkey % 3 = 0 THEN ' private ' WHEN c_custkey % 3 = 1 THEN '  ' ELSE 'public' END AS company_type
FROM customer
"""

VIEWS["f_roles"] = """
SELECT concat('R', p_partkey) AS role_id,
       concat(CASE p_size % 10 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Data Analyst II' WHEN 2 THEN 'Machine Learning Engineer'
              WHEN 3 THEN 'Junior Product Analyst' WHEN 4 THEN 'Account Executive' WHEN 5 THEN 'Director of Analytics'
              WHEN 6 THEN 'Data Scientist' WHEN 7 THEN 'Registered Nurse' WHEN 8 THEN 'Associate Consultant' ELSE 'Talent Community' END,
              ', ', p_name) AS role_name
FROM part
"""

VIEWS["f_skills"] = """
SELECT concat('S', k) AS skill_id, concat('skill', k) AS skill_name, concat(' Skill-', k, ' ') AS skill_slug,
       k % 4 <> 3 AS difficulty_relevant, concat('G', k % 6) AS group_id
FROM (SELECT DISTINCT p_partkey % 60 AS k FROM part) s
"""

VIEWS["f_job_skills"] = """
SELECT concat('J', l_orderkey) AS job_id,
       concat('S', CASE WHEN l_partkey % 100 < 50 THEN l_partkey % 10 ELSE 10 + l_partkey % 50 END) AS skill_id,
       concat('K', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS job_skills_id,
       CASE l_returnflag WHEN 'A' THEN 'required' WHEN 'N' THEN 'Preferred' ELSE 'nice-to-have' END AS skill_priority,
       CASE WHEN l_tax > 0.07 THEN NULL ELSE 1 - l_discount END AS confidence
FROM lineitem
"""

VIEWS["f_postings"] = """
SELECT concat('J', k) AS job_id, concat('SRC-', k) AS source_id,
       concat('C', o_custkey) AS company_id,
       CASE WHEN k % 97 = 0 THEN NULL ELSE concat('R', k % (SELECT count(*) FROM part)) END AS role_id,
       CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'raw' END AS status,
       o_orderstatus = 'O' AS is_public,
       CASE WHEN o_orderstatus = 'F' THEN CASE WHEN k % 10 = 0 THEN 'mass_cleanup' ELSE 'natural_cron' END END AS expired_reason,
       CASE WHEN k % 10 = 9 THEN 2 WHEN k % 10 = 8 THEN NULL ELSE 1 END AS data_tier_raw,
       CASE WHEN k % 10 = 9 THEN 2 ELSE 1 END AS data_tier,
       CASE WHEN k % 41 = 0 THEN 'suspect' WHEN k % 3 = 0 THEN 'ok' END AS data_quality,
       CASE k % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workday' ELSE 'adzuna' END AS ingestion_source,
       concat('T', o_custkey % 40) AS crawl_tenant,
       od AS posted_date,
       od + CAST(k % 3 AS INT) AS date_found,
       od AS ingested_at,
       od + life AS last_seen_at,
       life AS life_days,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid' WHEN '3-MEDIUM' THEN 'associate' WHEN '5-LOW' THEN 'entry' END AS experience_level,
       CASE k % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE 'onsite' END AS workplace_type,
       CASE k % 8 WHEN 0 THEN 'hour' WHEN 1 THEN ' Month ' WHEN 2 THEN '' ELSE 'year' END AS salary_period,
       smax AS salary_max,
       CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(floor(smax * 4 / 5) AS BIGINT) END AS salary_min,
       CASE WHEN k % 10 < 6 THEN 'US' WHEN k % 10 = 6 THEN NULL WHEN k % 10 < 9 THEN 'unknown' ELSE 'foreign' END AS loc_country,
       CASE k % 7 WHEN 0 THEN 'WA' WHEN 1 THEN 'IL' WHEN 2 THEN 'CA' WHEN 3 THEN 'NY' WHEN 4 THEN 'tx' WHEN 5 THEN NULL ELSE 'ON' END AS loc_state,
       CASE k % 7 WHEN 0 THEN 'Seattle' WHEN 1 THEN 'Chicago' WHEN 2 THEN 'San Francisco' WHEN 3 THEN 'Brooklyn' WHEN 4 THEN 'Austin' WHEN 5 THEN 'Remote' ELSE 'Toronto' END AS loc_city,
       CASE k % 6 WHEN 0 THEN 'data_ml' WHEN 1 THEN 'engineering' WHEN 2 THEN 'product' WHEN 3 THEN 'sales' WHEN 4 THEN 'data_ml' END AS domain,
       CASE k % 7 WHEN 0 THEN 'data_engineering' WHEN 1 THEN 'data_analytics' WHEN 2 THEN ' ml_engineering ' WHEN 3 THEN 'product_management' WHEN 4 THEN 'data_science' WHEN 5 THEN '' END AS role_category,
       concat('CO', o_custkey, '-', k % 7) AS canonical_opportunity_id,
       concat(CASE WHEN k % 29 = 0 THEN 'ftp' ELSE 'https' END, '://jobs.example.com/', o_custkey, '/', k) AS job_url,
       CASE k % 4 WHEN 0 THEN 'accepted_core' WHEN 1 THEN 'accepted_evidence' WHEN 2 THEN 'accepted_core' ELSE 'quarantine' END AS scope_status,
       CASE WHEN k % 17 = 0 THEN 'stale' END AS source_quality_status,
       k % 19 <> 0 AS has_embedding,
       concat('About company ', o_custkey, '. We value every applicant and offer the same benefits to all staff in every office of the group.', chr(10),
              'Requirements', chr(10), '- ', 1 + k % 9, '+ years of experience with skill', k % 10, chr(10),
              CASE WHEN k % 4 = 0 THEN concat('- Knowledge of tool', k % 12, ', and skill', k % 7, chr(10)) ELSE '' END,
              'Preferred', chr(10), '- Experience with skill', 10 + k % 50, chr(10),
              CASE WHEN k % 6 = 1 THEN concat('Benefits', chr(10), '- Access to skill', 20 + k % 9, ' labs', chr(10)) ELSE '' END,
              CASE WHEN k % 5 = 0 THEN 'Competitive pay.'
                   WHEN k % 3 = 0 THEN concat('Hourly rate: $', 20 + k % 60, ' - $', 30 + k % 60, ' per hour')
                   WHEN k % 3 = 1 THEN concat('The salary range is $', 60 + k % 40, ',000.00 to $', 110 + k % 90, ',500 per year')
                   ELSE concat('Salary range: $', 60 + k % 100, 'K - $', 160 + k % 120, 'K') END, chr(10),
              CASE k % 3 WHEN 0 THEN 'This is a remote role.' WHEN 1 THEN 'Hybrid schedule, full-time.' ELSE 'On-site only, part time.' END,
              CASE WHEN k % 23 = 0 THEN ' On-call rotation in a lean team with a fast-paced culture.' ELSE '' END,
              CASE WHEN k % 31 = 0 THEN ' We are not currently hiring for this opening.' ELSE '' END) AS description_text
FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS od, CAST((o_orderkey * 7919) % 120 AS INT) AS life,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL
                  WHEN o_orderkey % 8 = 0 THEN CAST(floor(o_totalprice / 2080) AS BIGINT)
                  WHEN o_orderkey % 8 = 1 THEN CAST(floor(o_totalprice / 12) AS BIGINT)
                  ELSE CAST(floor(o_totalprice) AS BIGINT) END AS smax
      FROM orders) o
"""

VIEWS["f_posting_events"] = """
SELECT event_id, concat('J', user_id) AS job_id, ts - INTERVAL '8200' DAY AS observed_at,
       CAST(ts - INTERVAL '8200' DAY AS DATE) AS posted_date,
       CASE event_type WHEN 'view' THEN 'appeared' WHEN 'error' THEN 'disappeared' WHEN 'purchase' THEN 'reappeared' ELSE 'seen' END AS event_type
FROM events
"""

# One crawl attempt per order: source, tenant, outcome.
VIEWS["f_tenant_runs"] = """
SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END AS source,
       concat('T', o_custkey % 40) AS crawl_tenant, CAST(o_orderdate AS DATE) AS started_on,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 1 END AS finished_on,
       CASE o_orderstatus WHEN 'O' THEN 'complete_nonzero' WHEN 'P' THEN 'complete_zero' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'partial_failure' END END AS status,
       CASE WHEN o_orderkey % 6 = 5 THEN 'partial_failure' ELSE 'complete_nonzero' END AS crawl_status,
       CASE WHEN o_orderkey % 7 = 3 THEN 1 ELSE 0 END AS errors,
       o_orderkey % 400 AS jobs_fetched, o_orderkey % 300 AS jobs_written, o_orderkey % 11 = 0 AS checkpoint_sweep,
       concat('detail-', o_orderkey) AS detail, o_orderkey % 2 = 0 AS degraded,
       CASE WHEN o_orderkey % 37 <> 0 THEN concat('N', year(CAST(o_orderdate AS DATE))) END AS orchestration_id
FROM orders
"""

# A resume per customer: the skills of everything that customer ordered first.
VIEWS["f_resumes"] = """
SELECT concat('U', c_custkey) AS resume_id,
       CASE c_custkey % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'associate' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' ELSE 'unknown' END AS exp_level,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 60000 + (c_custkey * 131) % 200000 END AS salary_floor,
       CASE c_custkey % 4 WHEN 0 THEN 'data_ml' WHEN 1 THEN 'engineering' WHEN 2 THEN 'product' ELSE 'sales' END AS target_domain,
       CASE WHEN c_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS cohort,
       concat('Summary', chr(10), CASE WHEN c_custkey % 4 = 0 THEN 'Senior engineer' WHEN c_custkey % 4 = 1 THEN 'Intern' ELSE 'Analyst' END,
              CASE WHEN c_custkey % 3 = 0 THEN concat(' with ', 1 + c_custkey % 14, '+ years of experience') ELSE '' END, chr(10),
              'Experience', chr(10), 'Acme Corp, Jan ', 2005 + c_custkey % 9, ' - Mar ', 2015 + c_custkey % 4, chr(10),
              'Skills', chr(10), 'skill', c_custkey % 10, ', skill', 10 + c_custkey % 50, ', craft', c_custkey % 6, chr(10),
              'Education', chr(10), 'Uses kubernetes and spark and kafka daily') AS resume_text
FROM customer
"""

VIEWS["f_resume_skills"] = """
SELECT concat('U', s_custkey) AS resume_id, concat('S', sk) AS skill_id
FROM (SELECT c_custkey AS s_custkey, c_custkey % 10 AS sk FROM customer
      UNION ALL SELECT c_custkey, (c_custkey * 3 + 1) % 10 FROM customer
      UNION ALL SELECT c_custkey, (c_custkey * 7 + 2) % 10 FROM customer
      UNION ALL SELECT c_custkey, 10 + c_custkey % 50 FROM customer
      UNION ALL SELECT c_custkey, 10 + (c_custkey * 11) % 50 FROM customer) u
GROUP BY s_custkey, sk
"""

VIEWS["f_follows"] = """
SELECT concat('V', c_custkey % 25) AS user_id, concat('C', c_custkey) AS company_id,
       CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'daily' ELSE 'weekly' END AS alert_frequency
FROM customer
"""

VIEWS["f_users"] = """
SELECT concat('V', n_nationkey) AS user_id, CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE concat('u', n_nationkey, '@example.com') END AS email,
       n_nationkey % 7 <> 0 AS active, CASE WHEN n_nationkey % 5 = 0 THEN false WHEN n_nationkey % 5 = 1 THEN true END AS email_enabled,
       CASE n_nationkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END AS frequency
FROM nation
"""

VIEWS["f_alerts"] = """
SELECT o_orderkey AS alert_id, concat('V', o_custkey % 25) AS user_id, concat('C', o_custkey) AS company_id, CAST(o_orderdate AS DATE) AS signal_date,
       o_orderstatus = 'F' AS delivered
FROM orders
"""

VIEWS["f_applications"] = """
SELECT o_orderkey AS application_id, concat('V', o_custkey % 25) AS user_id, concat('J', o_orderkey) AS job_id, CAST(o_orderdate AS DATE) AS applied_on,
       CASE WHEN o_orderstatus = 'P' THEN 'rejected' END AS outcome,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 9 END AS reminded_on
FROM orders
"""

VIEWS["f_signups"] = """
SELECT concat('W', o_orderkey) AS signup_id, concat('w', o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '@test.example' WHEN 1 THEN '' ELSE '@example.com' END) AS email,
       CAST(o_orderdate AS DATE) AS signed_up_on, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 1 END AS last_seen_on,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) + 2 END AS upgraded_on, CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderdate AS DATE) + 2 END AS nurtured_on
FROM orders
"""

VIEWS["f_candidates"] = """
SELECT CASE c_custkey % 5 WHEN 0 THEN 'workday' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'eightfold' WHEN 3 THEN 'oracle_cloud' ELSE 'lever' END AS platform,
       concat('tenant-', c_custkey) AS tenant,
       CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('wd', c_custkey % 6) ELSE concat('wd', c_custkey % 6, '/board', c_custkey % 9) END AS server,
       CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_name END AS company_name,
       CASE c_custkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'integrated' ELSE 'active' END AS status
FROM customer
"""

VIEWS["f_registry"] = """
SELECT CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'workday' END AS source,
       concat('T', s_suppkey) AS crawl_tenant, concat('T', s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN '/wd1/External' ELSE '' END) AS board_token,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE DATE '2001-08-01' - CAST(s_suppkey % 90 AS INT) END AS registry_seen
FROM supplier
"""

VIEWS["f_hosts"] = """
SELECT concat('H', s_suppkey) AS host_id, CASE s_suppkey % 3 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'oracle_cloud' ELSE 'sitemap' END AS platform,
       CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'dead' ELSE 'shadow' END AS status, s_suppkey % 50 AS last_job_count,
       DATE '2001-11-20' + CAST(s_suppkey % 12 AS INT) AS created_on
FROM supplier
"""

# One crawl of a host per order.
VIEWS["f_host_runs"] = """
SELECT o_orderkey AS run_id, concat('H', o_custkey % 100) AS host_id, CAST(o_orderdate AS DATE) AS started_on,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 60 END AS accepted_jobs, o_orderkey % 5 AS identity_mismatches, o_orderkey % 8 AS foreign_rejections
FROM orders
"""

_ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    """Prefix checking SQL with the views it mentions."""
    needed = [v for v in _ORDER if re.search(rf"\b{v}\b", sql)]
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive'):].strip()}"
    if re.match(r"with\b", body, re.I):
        return f"WITH {ctes},\n{body[len('with'):].strip()}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy access to the base tables and the views over them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL in which base tables appear by name; ``frames`` may stand in for some."""
        names = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", text)) & set(BASE)
        for name in names:
            text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{n: frames[n] if n in frames else self.base(n) for n in names})

    def _view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    @cached_property
    def companies(self): return self._view("f_companies")

    @cached_property
    def roles(self): return self._view("f_roles")

    @cached_property
    def skills(self): return self._view("f_skills")

    @cached_property
    def job_skills(self): return self._view("f_job_skills")

    @cached_property
    def postings(self): return self._view("f_postings")

    @cached_property
    def texts(self):
        """The postings again, spread over all cores for work on their texts."""
        return self.sql(VIEWS["f_postings"], orders=spread(self.base("orders")))

    @cached_property
    def documents(self): return spread(self.base("documents"))

    @cached_property
    def posting_events(self): return self._view("f_posting_events")

    @cached_property
    def tenant_runs(self): return self._view("f_tenant_runs")

    @cached_property
    def resumes(self): return self._view("f_resumes")

    @cached_property
    def resume_skills(self): return self._view("f_resume_skills")

    def view(self, name: str) -> DataFrame:
        return self._view(f"f_{name}")
