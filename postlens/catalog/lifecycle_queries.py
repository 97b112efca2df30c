"""Duplicates, lifecycle, quality gates, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, RADAR_DAY
from ..operators import dedup as D
from ..operators import lifecycle as L
from ..operators import quality as Q
from ..operators.relational import dedupe_best
from ..plans import core
from ..session import scratch_path
from ..sources import sinks
from ..streaming import events as S
from . import shared as H
from .registry import query, r
from .relational_queries import MAJOR
from .text_queries import NORM

# ---- duplicates ------------------------------------------------------------------------------


# Every posting, one in three of them a second time under another id, one in seven without a source id.
REPEATED = """
SELECT ingestion_source AS source, CASE WHEN life_days % 7 = 0 THEN ' ' ELSE source_id END AS source_id, job_id, ingested_at FROM f_postings
UNION ALL
SELECT ingestion_source, CASE WHEN life_days % 7 = 0 THEN ' ' ELSE source_id END, concat(job_id, 'r'), CASE WHEN life_days % 2 = 0 THEN ingested_at END FROM f_postings WHERE life_days % 3 = 0
"""


@query("dup_1_dedupe_source", f"""
SELECT source, source_id, job_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY ingested_at NULLS FIRST, job_id) AS rn FROM ({REPEATED}) r WHERE trim(source_id) <> '') q
WHERE rn = 1""")
def _(t):
    first = t.postings.select(F.col("ingestion_source").alias("source"), F.when(F.col("life_days") % 7 == 0, F.lit(" ")).otherwise(F.col("source_id")).alias("source_id"), "job_id", "ingested_at", "life_days")
    again = first.filter("life_days % 3 = 0").withColumns({"job_id": F.concat("job_id", F.lit("r")), "ingested_at": F.when(F.col("life_days") % 2 == 0, F.col("ingested_at"))})
    rows = first.unionByName(again).drop("life_days")
    return D.dedupe_source(rows, [F.col("ingested_at"), F.col("job_id")]).select("source", "source_id", "job_id")


@query("dup_2_canonical_exact", f"SELECT doc_id, concat('CO', substring(md5(concat_ws('|', lower(source), lower(lang), CASE WHEN {NORM} <> '' THEN {NORM} ELSE concat('source:', doc_id) END)), 1, 20)) AS canonical_id FROM documents")
def _(t):
    docs = t.documents
    return docs.select("doc_id", D.canonical_exact(docs, ["source", "lang"], "text", "doc_id").alias("canonical_id"))


NEAR = f"""WITH RECURSIVE nd AS (SELECT doc_id, concat(source, '|', lang) AS b, {NORM} AS body FROM documents), nn AS (SELECT * FROM nd WHERE body <> ''),
tk AS (SELECT doc_id, b, replace(body, ' ', '') AS tight, list_filter(string_split(body, ' '), lambda w: w <> '') AS w FROM nn),
sh AS (SELECT doc_id, b, tight, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS s FROM tk),
pr AS (SELECT x.doc_id AS a, y.doc_id AS c FROM sh x JOIN sh y ON x.b = y.b AND x.doc_id < y.doc_id WHERE x.tight = y.tight OR (least(len(x.s), len(y.s)) >= 0.995 * greatest(len(x.s), len(y.s))
  AND len(list_intersect(x.s, y.s)) >= 0.995 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))))),
ed AS (SELECT a, c FROM pr UNION SELECT c, a FROM pr), reach AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT reach.n, ed.c FROM reach JOIN ed ON ed.a = reach.m)"""


@query("dup_3_near_dup_clusters", NEAR + " SELECT n AS doc_id, min(m) AS cluster_id FROM reach GROUP BY 1")
def _(t):
    return D.near_dup_clusters(t.documents, "doc_id", ["source", "lang"], "text")


BLOCK_SETS = """tk AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> ''))) AS s FROM documents WHERE text IS NOT NULL),
cl AS (SELECT lang, s, min(doc_id) AS rep, count(*) AS copies FROM tk WHERE len(s) > 0 GROUP BY 1, 2)"""


@query("jn_15_block_pairs", f"""WITH {BLOCK_SETS}, pr AS (SELECT a.lang, a.rep AS src, b.rep AS dst, a.copies AS src_copies, b.copies AS dst_copies, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM cl a JOIN cl b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rep < b.rep AND least(len(a.s), len(b.s)) >= greatest(len(a.s), len(b.s)) * 0.5)
SELECT lang, src, dst, src_copies, dst_copies, {r('i / (t - i)', 6)} AS similarity FROM pr WHERE i >= (t - i) * 0.5""")
def _(t):
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return D.block_pairs(t.documents.filter(F.col("text").isNotNull()), "doc_id", "lang", words, 0.5)


CHAIN = "SELECT c_custkey AS src, CAST(floor(c_custkey / 3) AS BIGINT) + 100000 AS dst FROM customer UNION ALL SELECT c_custkey + 100000, c_custkey * 2 + 100000 FROM customer WHERE c_acctbal > 5000"


@query("dup_4_connected_components", f"WITH RECURSIVE e0 AS ({CHAIN}), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), reach AS (SELECT src AS n, src AS m FROM e UNION SELECT reach.n, e.dst FROM reach JOIN e ON e.src = reach.m) SELECT n AS node, min(m) AS component FROM reach GROUP BY 1")
def _(t):
    return D.connected_components(t.sql(CHAIN))


@query("dup_5_collapse_city_spam", """WITH sp AS (SELECT company_id, role_id, arg_min(job_id, (ingested_at, job_id)) AS keep FROM rp WHERE status = 'raw' AND data_tier = 1 GROUP BY 1, 2 HAVING count(DISTINCT loc_city) >= 3),
rp AS (SELECT job_id, company_id, concat('G', life_days % 3) AS role_id, status, data_tier, expired_reason, ingested_at, loc_city, loc_state, workplace_type FROM f_postings),
j AS (SELECT rp.*, keep, keep IS NOT NULL AND status = 'raw' AND data_tier = 1 AS hit FROM rp LEFT JOIN sp USING (company_id, role_id))
SELECT job_id, CASE WHEN hit AND job_id <> keep THEN 'expired' ELSE status END AS status, CASE WHEN hit AND job_id <> keep THEN 'city_spam_dedup' ELSE expired_reason END AS expired_reason,
 CASE WHEN hit AND job_id = keep THEN 'Multiple Locations' ELSE loc_city END AS loc_city, CASE WHEN hit AND job_id = keep THEN NULL ELSE loc_state END AS loc_state, CASE WHEN hit AND job_id = keep THEN 'remote' ELSE workplace_type END AS workplace_type FROM j""".replace("WITH sp AS (SELECT company_id, role_id, arg_min(job_id, (ingested_at, job_id)) AS keep FROM rp WHERE status = 'raw' AND data_tier = 1 GROUP BY 1, 2 HAVING count(DISTINCT loc_city) >= 3),\nrp AS (SELECT job_id, company_id, concat('G', life_days % 3) AS role_id, status, data_tier, expired_reason, ingested_at, loc_city, loc_state, workplace_type FROM f_postings),",
    "WITH rp AS (SELECT job_id, company_id, concat('G', life_days % 3) AS role_id, status, data_tier, expired_reason, ingested_at, loc_city, loc_state, workplace_type FROM f_postings),\nsp AS (SELECT company_id, role_id, arg_min(job_id, (ingested_at, job_id)) AS keep FROM rp WHERE status = 'raw' AND data_tier = 1 GROUP BY 1, 2 HAVING count(DISTINCT loc_city) >= 3),"))
def _(t):
    rows = t.postings.withColumn("role_id", F.concat(F.lit("G"), (F.col("life_days") % 3).cast("string")))
    return D.collapse_city_spam(rows, min_cities=3).select("job_id", "status", "expired_reason", "loc_city", "loc_state", "workplace_type")


@query("dup_6_source_overlap", "SELECT company_id, string_agg(ingestion_source, ',' ORDER BY ingestion_source) AS sources, string_agg(CAST(n AS VARCHAR), ',' ORDER BY ingestion_source) AS role_counts FROM (SELECT company_id, ingestion_source, count(*) AS n FROM f_postings WHERE status = 'raw' GROUP BY 1, 2) q GROUP BY 1 HAVING count(*) > 1")
def _(t):
    rows = t.postings.filter(F.col("status") == "raw").groupBy("company_id", "ingestion_source").agg(F.count(F.lit(1)).alias("n"))
    out = D.source_overlap(rows, "company_id", "ingestion_source", "n")
    return out.select("company_id", F.concat_ws(",", "sources").alias("sources"), F.array_join(F.transform("role_counts", lambda x: x.cast("string")), ",").alias("role_counts"))


SIGHT = "SELECT concat(CASE WHEN k % 2 = 0 THEN ' ACME' ELSE 'acme' END, k % 90, ' ') AS tenant, CASE WHEN k % 3 = 0 THEN 'WD1' WHEN k % 3 = 1 THEN 'wd1 ' END AS server, CASE WHEN k % 5 = 0 THEN concat(CASE WHEN k % 4 = 0 THEN 'Board' ELSE 'board' END, k % 7) WHEN k % 5 = 1 THEN '' END AS board, CASE WHEN k % 4 = 1 THEN NULL ELSE concat('Co ', k) END AS company_name, concat('via', k % 3) AS discovery_source, k FROM (SELECT o_orderkey AS k FROM orders) o"


@query("dup_7_merge_observations", f"""WITH s AS (SELECT lower(trim(tenant)) AS tenant, nullif(lower(trim(server)), '') AS server, nullif(trim(board), '') AS board, company_name, discovery_source, k FROM ({SIGHT}) z),
m AS (SELECT tenant, server, lower(board) AS lb, arg_min(board, k) AS board, arg_min(company_name, k) FILTER (WHERE company_name IS NOT NULL) AS company_name, arg_min(discovery_source, k) AS discovery_source FROM s GROUP BY 1, 2, 3)
SELECT tenant, server, board, company_name, discovery_source FROM m WHERE lb IS NOT NULL OR tenant NOT IN (SELECT tenant FROM m WHERE lb IS NOT NULL)""")
def _(t):
    return D.merge_observations(t.sql(SIGHT), F.col("k"))


@query("dup_9_compact_queue", "SELECT url, wanted, queued_on FROM (SELECT concat('u', o_custkey) AS url, o_orderstatus AS wanted, CAST(o_orderdate AS DATE) AS queued_on, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q WHERE rn = 1")
def _(t):
    rows = t.sql("SELECT concat('u', o_custkey) AS url, o_orderstatus AS wanted, CAST(o_orderdate AS DATE) AS queued_on, o_orderkey FROM orders")
    return D.compact_queue(rows, "url", [F.col("queued_on").desc(), F.col("o_orderkey").desc()]).drop("o_orderkey")


@query("dup_10_invalidate_derived", "SELECT job_id, CASE WHEN life_days % 3 <> 0 THEN domain END AS domain, CASE WHEN life_days % 3 <> 0 THEN experience_level END AS experience_level, life_days % 3 = 0 AS content_changed FROM f_postings")
def _(t):
    old = t.postings.select("job_id", F.md5("description_text").alias("desc_hash"), "domain", "experience_level")
    new = t.postings.select("job_id", F.md5(F.when(F.col("life_days") % 3 == 0, F.concat("description_text", F.lit("!"))).otherwise(F.col("description_text"))).alias("desc_hash"), "domain", "experience_level")
    return D.invalidate_derived(new, old, "job_id", "desc_hash", ["domain", "experience_level"]).drop("desc_hash")


# ---- lifecycle -------------------------------------------------------------------------------

CLEAN_SQL = "cl AS (SELECT source, crawl_tenant FROM (SELECT *, row_number() OVER (PARTITION BY source, crawl_tenant ORDER BY started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1 AND status IN ('complete_nonzero', 'complete_zero') AND crawl_status IN ('complete_nonzero', 'complete_zero') AND errors = 0)"


@query("lc_1_lifecycle_events", f"SELECT p.job_id, CASE WHEN domain IS NULL THEN 'appeared' ELSE 'reappeared' END AS event_type, DATE '{AS_OF}' AS observed_on, posted_date, CASE WHEN domain IS NOT NULL THEN DATE '{AS_OF}' - last_seen_at END AS gap_days FROM f_postings p WHERE domain IS NULL OR status = 'expired'")
def _(t):
    known = t.postings.filter(F.col("domain").isNotNull())
    return L.lifecycle_events(known, t.postings, AS_OF)


EXPIRE = f"""{CLEAN_SQL}, ev AS (SELECT p.*, CASE WHEN data_tier = 1 AND p.status <> 'expired' AND cl.source IS NOT NULL AND last_seen_at < DATE '{RADAR_DAY}' - 1 THEN 'disappeared' WHEN data_tier = 1 AND p.status = 'expired' AND last_seen_at >= DATE '{RADAR_DAY}' - 1 THEN 'reappeared' END AS event_type
 FROM f_postings p LEFT JOIN cl ON cl.source = p.ingestion_source AND cl.crawl_tenant = p.crawl_tenant)"""


@query("lc_2_expire_states", f"WITH {EXPIRE} SELECT job_id, CASE event_type WHEN 'disappeared' THEN 'expired' WHEN 'reappeared' THEN 'raw' ELSE status END AS status, CASE WHEN event_type = 'disappeared' THEN 'natural_cron' WHEN event_type IS NULL THEN expired_reason END AS expired_reason FROM ev")
def _(t):
    return L.expire(t.postings, L.clean_tenants(t.tenant_runs), RADAR_DAY)[0].select("job_id", "status", "expired_reason")


@query("lc_2_expire_events", f"WITH {EXPIRE} SELECT job_id, event_type, CASE event_type WHEN 'disappeared' THEN last_seen_at ELSE DATE '{RADAR_DAY}' END AS observed_on, CASE event_type WHEN 'reappeared' THEN DATE '{RADAR_DAY}' - last_seen_at END AS gap_days FROM ev WHERE event_type IS NOT NULL")
def _(t):
    return L.expire(t.postings, L.clean_tenants(t.tenant_runs), RADAR_DAY)[1]


@query("lc_3_clean_tenants", f"WITH {CLEAN_SQL} SELECT * FROM cl")
def _(t):
    return L.clean_tenants(t.tenant_runs)


@query("lc_4_expire_host", f"SELECT job_id, 'expired' AS status, 'career_host_closed' AS expired_reason FROM f_postings WHERE ingestion_source = 'lever' AND crawl_tenant = 'T11' AND status = 'raw' AND last_seen_at < DATE '{RADAR_DAY}'")
def _(t):
    return L.expire_host(t.postings, "lever", "T11", RADAR_DAY).select("job_id", "status", "expired_reason")


@query("lc_6_refresh_cache", f"WITH {H.REPOSTS} SELECT observed_on, signal_class, count(*) AS n FROM reposts GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "repost-cache")
    cached = H.reposts(t).select("event_id", "job_id", "signal_class", "observed_on")
    sinks.write_snapshot(cached, path, day_col="observed_on")
    # A later run replaces only the days it recomputes.
    recent = cached.filter(F.col("observed_on") >= F.lit("2001-07-25").cast("date"))
    sinks.write_snapshot(recent, path, day_col="observed_on")
    return t.spark.read.parquet(path).groupBy("observed_on", "signal_class").agg(F.count(F.lit(1)).alias("n"))


@query("lc_7_merge_outcomes", """SELECT source, crawl_tenant, CASE WHEN bool_or(status = 'partial_failure') OR (bool_or(status = 'failed') AND NOT bool_and(status = 'failed')) THEN 'partial_failure' WHEN bool_and(status = 'failed') THEN 'failed'
 WHEN max(jobs_fetched) > 0 THEN 'complete_nonzero' ELSE 'complete_zero' END AS status, max(jobs_fetched) AS jobs_fetched, CAST(sum(errors) AS BIGINT) AS errors, arg_max(detail, (started_on, run_id)) AS detail FROM f_tenant_runs GROUP BY 1, 2""")
def _(t):
    return L.merge_outcomes(t.tenant_runs)


HOST_RUNS = """
SELECT o_orderkey AS run_id, o_orderkey % 9 AS jobs, o_orderkey % 9 * 20 AS target_jobs, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS errors, o_orderkey % 4 AS identity_mismatches,
       o_orderkey % 3 AS host_jobs, o_custkey % 130 AS brand_jobs, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 3 END AS sitemap_roots,
       CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 0 END END AS sitemap_child_errors, CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS sitemap_errors
FROM orders
"""


@query("lc_9_host_run_outcome", f"""
WITH x AS (SELECT *, errors = 0 AND CASE WHEN sitemap_child_errors IS NOT NULL THEN sitemap_roots > 0 AND sitemap_child_errors = 0 ELSE sitemap_errors IS NULL END AS complete,
                  identity_mismatches * 100 <= greatest(target_jobs, 1) AS few, brand_jobs = 0 OR (host_jobs > 0 AND brand_jobs * 4 <= greatest(target_jobs, 1)) AS backed FROM ({HOST_RUNS}) r)
SELECT run_id, CASE WHEN NOT complete THEN 'partial_failure' WHEN target_jobs > 0 AND NOT few THEN 'quality_rejected' WHEN jobs > 0 THEN 'complete_nonzero' ELSE 'complete_zero' END AS status,
       jobs > 0 AND complete AND few AND backed AS clean FROM x""")
def _(t):
    return L.host_run_outcome(t.sql(HOST_RUNS)).select("run_id", "status", "clean")


@query("lc_9_mature_hosts", f"""WITH rn AS (SELECT concat('H', o_custkey % 100) AS host_id, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS ran_on, o_orderstatus <> 'F' AS clean, o_orderkey % 9 AS jobs, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS mismatches FROM orders),
ft AS (SELECT host_id, min(ran_on) FILTER (WHERE clean) AS first_clean, arg_max(clean, (ran_on, run_id)) AS clean, arg_max(jobs, (ran_on, run_id)) AS jobs, arg_max(mismatches, (ran_on, run_id)) AS mm FROM rn GROUP BY 1),
x AS (SELECT h.*, ft.clean, CASE WHEN coalesce(jobs > 0 AND mm = 0 AND DATE '{AS_OF}' - first_clean >= 2, false) THEN 2 ELSE 7 END AS days_needed FROM f_hosts h LEFT JOIN ft USING (host_id))
SELECT host_id, days_needed, CASE WHEN status = 'shadow' AND coalesce(clean, false) AND DATE '{AS_OF}' - created_on >= days_needed THEN 'active' ELSE status END AS status FROM x""")
def _(t):
    runs = t.sql("SELECT concat('H', o_custkey % 100) AS host_id, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS ran_on, o_orderstatus <> 'F' AS clean, o_orderkey % 9 AS jobs, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS mismatches FROM orders")
    return L.mature_hosts(t.view("hosts"), runs, AS_OF).select("host_id", "days_needed", "status")


EVENT_SQL = "SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, n, total FROM (SELECT date_trunc('day', ts) AS w, event_type, count(*) AS n, CAST(round(CAST(sum(value) AS DECIMAL(28,8)), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2) q WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _tidy(df):
    from ..functions.columns import rounded

    return df.withColumns({"total": rounded(F.col("total"), 4), "window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz")})


@query("lc_8_stream_event_counts", EVENT_SQL)
def _(t):
    stream = S.event_stream(t.spark, f"{t.root}/events*.parquet", t.base("events").schema)
    return _tidy(S.run_to_table(S.event_counts(stream), "event-counts"))


@query("lc_8_batch_event_counts", EVENT_SQL)
def _(t):
    return _tidy(S.batch_event_counts(t.base("events")))


# A tenth of the events arrives after all others, some of them once more.
ARRIVALS = """ar AS (SELECT event_id, ts, event_type, value, CASE WHEN event_id % 10 = 0 THEN 3 WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS part FROM events UNION ALL SELECT event_id, ts, event_type, value, 3 FROM events WHERE event_id % 25 = 1)"""


@query("lc_8_late_rows", f"""WITH {ARRIVALS}, wm AS (SELECT 2 AS part, max(ts) - INTERVAL 1 HOUR AS m FROM ar WHERE part = 1 UNION ALL SELECT 3, max(ts) - INTERVAL 1 HOUR FROM ar WHERE part < 3),
jd AS (SELECT ar.*, coalesce(ts <= m, false) AS late FROM ar LEFT JOIN wm USING (part)),
ok AS (SELECT event_id, min(ts) AS ts, min(event_type) AS event_type FROM jd WHERE NOT late GROUP BY 1)
SELECT 'window' AS kind, date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM ok GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ar)
UNION ALL SELECT 'dropped', NULL, NULL, count(*) FROM jd WHERE late""")
def _(t):
    arrived = t.sql(f"WITH {ARRIVALS} SELECT * FROM ar")
    parts = [arrived.filter(F.col("part") == k).drop("part") for k in (1, 2, 3)]
    rows, dropped = S.run_arrivals(parts, S.event_counts, "arrivals")
    windows = rows.select(F.lit("window").alias("kind"), F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    return windows.unionByName(t.spark.range(1).select(F.lit("dropped").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(None).cast("string").alias("event_type"), F.lit(dropped).cast("long").alias("n")))


@query("lc_8_sessions", """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    stream = S.event_stream(t.spark, f"{t.root}/events*.parquet", t.base("events").schema)
    out = S.run_to_table(S.session_counts(stream, "user_id", "12 hours"), "sessions")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


LIFE_SQL = """WITH d AS (SELECT concat('J', user_id) AS job_id, CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2),
g AS (SELECT *, day - lag(day) OVER w AS gap, lag(hi) OVER w AS before, lead(day) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY job_id ORDER BY day))
SELECT job_id, 'appeared' AS event_type, lo AS observed_at, CAST(NULL AS INT) AS gap_days FROM g WHERE gap IS NULL UNION ALL SELECT job_id, 'reappeared', lo, gap FROM g WHERE gap >= 2 UNION ALL SELECT job_id, 'disappeared', before, NULL FROM g WHERE gap >= 2
UNION ALL SELECT job_id, 'disappeared', hi, NULL FROM g WHERE nxt IS NULL AND CAST(day + 2 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


@query("lc_1_lifecycle_stream", LIFE_SQL)
def _(t):
    stream = S.event_stream(t.spark, f"{t.root}/events*.parquet", t.base("events").schema)
    sightings = stream.select(F.concat(F.lit("J"), F.col("user_id").cast("string")).alias("job_id"), F.col("ts").alias("observed_at"))
    return S.run_to_table(S.lifecycle_stream(sightings), "lifecycle").withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


# A batch over the first weeks, then a stream from its state: together what one run over all gives.
@query("lc_1_hand_over", LIFE_SQL)
def _(t):
    from ..streaming.handover import hand_over

    seen = t.base("events").select(F.concat(F.lit("J"), F.col("user_id").cast("string")).alias("job_id"), F.col("ts").cast("timestamp").alias("observed_at"))
    cut = F.lit("2024-01-16 09:30:00").cast("timestamp")
    return hand_over(seen.filter(F.col("observed_at") < cut), seen.filter(F.col("observed_at") >= cut)).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


# ---- quality -----------------------------------------------------------------------------------

CAND = f"""cand AS (SELECT canonical_opportunity_id, job_id FROM (SELECT p.canonical_opportunity_id, job_id, row_number() OVER (PARTITION BY p.canonical_opportunity_id ORDER BY CASE ingestion_source WHEN 'greenhouse' THEN 3 WHEN 'ashby' THEN 4 WHEN 'lever' THEN 5 WHEN 'workday' THEN 6 ELSE 7 END, length(description_text) DESC, posted_date DESC, last_seen_at DESC, job_id) AS rn
 FROM f_postings p JOIN f_companies c USING (company_id) JOIN f_roles ro USING (role_id) WHERE status = 'raw' AND data_tier = 1 AND ingestion_source <> 'adzuna' AND scope_status IN ('accepted_core', 'accepted_evidence') AND domain IS NOT NULL AND role_category IS NOT NULL AND experience_level IS NOT NULL
 AND has_embedding AND length(description_text) >= 100 AND last_seen_at >= DATE '1999-01-01' - 3 AND posted_date <= DATE '1999-01-01' AND regexp_matches(job_url, '(?i)^https?://') AND coalesce(source_quality_status, 'active') = 'active'
 AND NOT regexp_matches(description_text, '(?i)not currently hiring') AND NOT regexp_matches(role_name, '(?i)talent (pool|community|network)') AND NOT (lower(company_name) LIKE '%firm 77%' OR lower(trim(company_name)) = 'firm 5 inc' OR lower(company_name) LIKE '%firm 41 %')
 AND ((lower(coalesce(loc_country, '')) IN ('us', 'united states', 'usa') AND (loc_state IS NULL OR upper(loc_state) IN ({MAJOR}))) OR (lower(coalesce(loc_country, '')) IN ('', 'unknown') AND upper(coalesce(loc_state, '')) IN ({MAJOR})))) q WHERE rn = 1)"""


def candidates(t):
    return Q.publication_candidates(t.postings, t.companies, t.roles, "1999-01-01", H.EXCLUSIONS)


@query("qlt_1_publication_candidates", f"WITH {CAND} SELECT * FROM cand")
def _(t):
    return candidates(t)


GATED = CAND.replace(" FROM f_postings p ", " FROM (SELECT * FROM f_postings WHERE life_days % 3 <> 0 AND life_days % 5 <> 1) p ")


@query("qlt_1_publication_gate", f"WITH {GATED} SELECT * FROM cand")
def _(t):
    life = F.col("life_days")
    rows = t.postings.withColumns({
        "valid_through": F.when(life % 3 == 0, F.lit("1998-12-31")).when(life % 3 == 1, F.lit("1999-01-01")).cast("date"),
        "location_evidence": F.when(life % 5 == 1, F.when(life % 2 == 0, F.lit("{}"))).otherwise(F.lit('{"rule":"us_state"}'))})
    return Q.publication_candidates(rows, t.companies, t.roles, "1999-01-01", H.EXCLUSIONS)


NEXT = "nx AS (SELECT job_id FROM f_postings WHERE status = 'raw' AND domain IS NOT NULL AND role_id IS NOT NULL), ch AS (SELECT coalesce(l.job_id, nx.job_id) AS job_id, CASE WHEN nx.job_id IS NULL THEN 'URL_DELETED' ELSE 'URL_UPDATED' END AS notification_type FROM (SELECT job_id FROM f_postings WHERE is_public) l FULL JOIN nx ON nx.job_id = l.job_id WHERE l.job_id IS NULL OR nx.job_id IS NULL)"


def publication(t):
    wanted = t.postings.filter((F.col("status") == "raw") & F.col("domain").isNotNull() & F.col("role_id").isNotNull()).select("job_id")
    return Q.publish(t.postings, wanted, t.roles, minimum=10)


@query("qlt_2_publish_queue", f"WITH {NEXT} SELECT job_id, notification_type, concat('https://example.com/openings/', job_id, '/', regexp_replace(regexp_replace(lower(coalesce(role_name, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS url FROM ch JOIN f_postings USING (job_id) LEFT JOIN f_roles USING (role_id)")
def _(t):
    return publication(t)["queue"]


@query("qlt_2_publish_run", f"WITH {NEXT} SELECT (SELECT count(*) FROM f_postings WHERE is_public) AS prior_count, (SELECT count(*) FROM nx) AS candidate_count, count(*) FILTER (WHERE notification_type = 'URL_UPDATED') AS activated, count(*) FILTER (WHERE notification_type = 'URL_DELETED') AS deactivated FROM ch")
def _(t):
    return publication(t)["run"]


@query("qlt_2_published_flag_guard", "SELECT job_id, NOT is_public AS is_public FROM f_postings WHERE life_days % 50 = 0")
def _(t):
    changed = t.postings.withColumn("is_public", F.when(F.col("life_days") % 50 == 0, ~F.col("is_public")).otherwise(F.col("is_public")))
    return Q.guard_published_flag(t.postings, changed)


@query("qlt_2_content_update", f"SELECT job_id, CASE WHEN life_days % 4 = 0 THEN DATE '{AS_OF}' ELSE ingested_at END AS content_updated_on FROM f_postings")
def _(t):
    old = t.postings.withColumn("content_updated_on", F.col("ingested_at"))
    new = t.postings.withColumns({"content_updated_on": F.lit(None).cast("date"), "loc_city": F.when(F.col("life_days") % 4 == 0, F.lit("Elsewhere")).otherwise(F.col("loc_city"))})
    return Q.track_content_update(old, new, AS_OF).select("job_id", "content_updated_on")


@query("qlt_3_ingest_gate", """WITH ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY checkpoint_sweep DESC, started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1), wr AS (SELECT source, sum(jobs_written) AS w FROM f_tenant_runs GROUP BY 1),
rw AS (SELECT ingestion_source AS source, count(*) AS n FROM f_postings WHERE data_tier = 1 AND last_seen_at >= DATE '2001-11-01' GROUP BY 1), ex AS (SELECT unnest(['greenhouse', 'lever', 'ashby', 'workday', 'career_site']) AS source)
SELECT ex.source, 'never_ran' AS violation FROM ex LEFT JOIN ed USING (source) WHERE ed.source IS NULL UNION ALL SELECT source, 'incomplete' FROM ed WHERE NOT (crawl_status IN ('complete_nonzero', 'complete_zero') AND errors = 0) UNION ALL SELECT source, 'still_running' FROM ed WHERE finished_on IS NULL
UNION ALL SELECT source, 'no_current_rows' FROM wr LEFT JOIN rw USING (source) WHERE w > 0 AND coalesce(n, 0) = 0""")
def _(t):
    return Q.ingest_gate(t.tenant_runs, t.postings, ["greenhouse", "lever", "ashby", "workday", "career_site"], "2001-11-01")


@query("qlt_4_tenant_failures", "SELECT source, count(*) FILTER (WHERE status NOT IN ('complete_nonzero', 'complete_zero')) AS failed_tenants FROM (SELECT *, row_number() OVER (PARTITION BY source, crawl_tenant ORDER BY started_on DESC, run_id DESC) AS rn FROM f_tenant_runs) q WHERE rn = 1 GROUP BY 1")
def _(t):
    from ..plans.ops import tenant_failures

    return tenant_failures(t.tenant_runs)


@query("qlt_5_not_null", "SELECT 'role_id is null' AS violation, count(*) AS n FROM f_postings WHERE role_id IS NULL UNION ALL SELECT 'domain is null', count(*) FROM f_postings WHERE domain IS NULL")
def _(t):
    return Q.expect_not_null(t.postings, ["job_id", "role_id", "domain"])


@query("qlt_5_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.expect_unique(t.base("lineitem"), ["l_orderkey", "l_linenumber"])


@query("qlt_5_accepted_values", "SELECT skill_priority, count(*) AS n FROM f_job_skills WHERE skill_priority NOT IN ('required', 'preferred', 'nice-to-have') GROUP BY 1")
def _(t):
    return Q.expect_accepted(t.job_skills, "skill_priority", ["required", "preferred", "nice-to-have"])


@query("qlt_5_relationship", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(t):
    return Q.expect_relationship(t.base("lineitem"), "l_suppkey", t.base("supplier").filter("s_acctbal > 0"), "s_suppkey")


@query("qlt_5_expression", "SELECT 'seen before posted plus a month' AS violation, count(*) AS n FROM f_postings WHERE last_seen_at < posted_date + 30")
def _(t):
    return Q.expect_expression(t.postings, "seen before posted plus a month", F.col("last_seen_at") >= F.date_add("posted_date", 30))


@query("qlt_6_audit_distribution", "WITH z AS (SELECT domain AS before, CASE WHEN life_days % 5 = 0 THEN 'sales' ELSE domain END AS after FROM f_postings) SELECT before, after, count(*) AS n, before IS DISTINCT FROM after AS changed FROM z GROUP BY 1, 2")
def _(t):
    new = t.postings.select("job_id", F.when(F.col("life_days") % 5 == 0, F.lit("sales")).otherwise(F.col("domain")).alias("domain"))
    return Q.audit_distribution(t.postings, new, "job_id", "domain")


# ---- sinks -------------------------------------------------------------------------------------

@query("snk_1_upsert", """WITH o AS (SELECT job_id, salary_max, domain, job_url, experience_level FROM f_postings WHERE status = 'raw'), n AS (SELECT job_id, salary_min AS salary_max, CASE WHEN life_days % 2 = 0 THEN domain END AS domain, CASE WHEN life_days % 3 = 0 THEN concat(job_url, '?v=2') ELSE job_url END AS job_url, 'mid' AS experience_level FROM f_postings WHERE is_public OR status = 'expired')
SELECT coalesce(o.job_id, n.job_id) AS job_id, CASE WHEN n.job_id IS NULL THEN o.salary_max ELSE n.salary_max END AS salary_max, CASE WHEN n.job_id IS NULL THEN o.domain WHEN o.job_id IS NULL THEN n.domain ELSE coalesce(n.domain, o.domain) END AS domain,
 CASE WHEN n.job_id IS NULL THEN o.job_url ELSE n.job_url END AS job_url, CASE WHEN n.job_id IS NULL THEN o.experience_level WHEN o.job_id IS NULL THEN n.experience_level WHEN o.job_url = n.job_url THEN o.experience_level END AS experience_level FROM o FULL JOIN n ON o.job_id = n.job_id""")
def _(t):
    cols = ["job_id", "salary_max", "domain", "job_url", "experience_level"]
    old = t.postings.filter(F.col("status") == "raw").select(*cols)
    new = t.postings.filter(F.col("is_public") | (F.col("status") == "expired")).select(
        "job_id", F.col("salary_min").alias("salary_max"), F.when(F.col("life_days") % 2 == 0, F.col("domain")).alias("domain"),
        F.when(F.col("life_days") % 3 == 0, F.concat("job_url", F.lit("?v=2"))).otherwise(F.col("job_url")).alias("job_url"), F.lit("mid").alias("experience_level"))
    return sinks.upsert(old, new, ["job_id"], {"domain": "coalesce", "experience_level": ("reset", "job_url")})


@query("snk_2_partition_snapshot", "SELECT CAST(date_trunc('month', ingested_at) AS DATE) AS snapshot_date, count(*) AS n, CAST(sum(CASE WHEN ingested_at >= DATE '2001-07-01' THEN 2 ELSE 1 END) AS BIGINT) AS version FROM f_postings GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "snapshots")
    rows = t.postings.select("job_id", F.trunc("ingested_at", "month").alias("snapshot_date"))
    sinks.write_snapshot(rows.withColumn("v", F.lit(1)), path)
    sinks.write_snapshot(rows.filter(F.col("snapshot_date") >= F.lit("2001-07-01").cast("date")).withColumn("v", F.lit(2)), path)
    return t.spark.read.parquet(path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("version"))


@query("snk_3_swap_table", "SELECT domain, count(*) AS n FROM f_postings WHERE is_public GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "index")
    sinks.swap_table(t.postings.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), path)
    sinks.swap_table(t.postings.filter("is_public").groupBy("domain").agg(F.count(F.lit(1)).alias("n")), path)
    return sinks.read_current(t.spark, path)


@query("snk_4_purge_expired", "SELECT 'parent' AS table_name, count(*) AS n FROM f_postings WHERE last_seen_at < DATE '2001-12-01' - 400 UNION ALL SELECT 'job_skills', count(*) FROM f_job_skills j WHERE EXISTS (SELECT 1 FROM f_postings p WHERE p.job_id = j.job_id AND last_seen_at < DATE '2001-12-01' - 400)")
def _(t):
    return sinks.purge_expired(t.postings, "last_seen_at", 400, AS_OF, "job_id", {"job_skills": t.job_skills})[2]


@query("snk_4_purge_kept", "SELECT count(*) AS kept FROM f_job_skills j WHERE NOT EXISTS (SELECT 1 FROM f_postings p WHERE p.job_id = j.job_id AND last_seen_at < DATE '2001-12-01' - 400)")
def _(t):
    return sinks.purge_expired(t.postings, "last_seen_at", 400, AS_OF, "job_id", {"job_skills": t.job_skills})[1]["job_skills"].agg(F.count(F.lit(1)).alias("kept"))
