"""Company history, radar, alerts and their consumers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, RADAR_DAY
from ..plans import company as K
from ..plans import market as M
from ..session import scratch_path
from ..sources import sinks
from . import shared as S
from .registry import query, r
from .relational_queries import US_PLACE

FIRST = "2001-07-25"

HISTORY = S.REPOSTS + f""", nm AS (SELECT company_id, company_name, regexp_replace(lower(company_name), '[^a-z0-9]+', '', 'g') AS company_key FROM f_companies),
hj AS (SELECT p.*, company_name, company_key FROM f_postings p JOIN nm USING (company_id) WHERE data_tier = 1),
pn AS (SELECT company_key, company_name FROM (SELECT company_key, company_name, row_number() OVER (PARTITION BY company_key ORDER BY count(*) DESC, length(company_name) DESC, company_name) AS rn FROM hj GROUP BY 1, 2) q WHERE rn = 1),
hb AS (SELECT company_key, min(date_found) AS coverage_started_at, max(last_seen_at) AS last_observed_at, count(*) AS source_postings, count(DISTINCT canonical_opportunity_id) AS observed_opportunities,
  count(*) FILTER (WHERE status = 'raw' AND is_public) AS active_source_postings, count(DISTINCT canonical_opportunity_id) FILTER (WHERE status = 'raw' AND is_public) AS active_opportunities,
  count(*) FILTER (WHERE salary_min IS NOT NULL OR salary_max IS NOT NULL) AS salary_disclosed,
  {r("quantile_cont(last_seen_at - date_found, 0.5) FILTER (WHERE status = 'expired' AND last_seen_at - date_found >= 2)", 1)} AS median_observed_lifetime_days FROM hj GROUP BY 1),
hs AS (SELECT company_key, count(*) FILTER (WHERE signal_class = 'individual_repost_signal') AS a, count(*) FILTER (WHERE signal_class = 'bulk_ats_date_refresh') AS b,
  count(DISTINCT observed_on) FILTER (WHERE signal_class = 'bulk_ats_date_refresh') AS c FROM reposts JOIN nm USING (company_id) GROUP BY 1),
history AS (SELECT hb.*, company_name, coalesce(a, 0) AS individual_repost_signals, coalesce(b, 0) AS bulk_ats_refresh_events, coalesce(c, 0) AS bulk_refresh_days,
  {r('salary_disclosed * 100.0 / source_postings', 1)} AS salary_transparency_pct FROM hb JOIN pn USING (company_key) LEFT JOIN hs USING (company_key))"""


def history(t):
    return K.company_history(t.postings, t.companies, S.reposts(t))


@query("bi_12_company_history", f"WITH {HISTORY} SELECT * FROM history")
def _(t):
    return history(t)


@query("bi_13_company_daily_snapshot", f"WITH {HISTORY} SELECT DATE '{RADAR_DAY}' AS snapshot_date, company_key, company_name, active_source_postings, active_opportunities, observed_opportunities, salary_transparency_pct, individual_repost_signals, bulk_ats_refresh_events FROM history")
def _(t):
    return K.company_daily_snapshot(history(t), RADAR_DAY)


def radar_sql(first: str, last: str, as_of: str) -> str:
    return f"""{S.PAY}, {S.REPOSTS}, days AS (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS d),
el0 AS (SELECT job_id, company_id, domain, status, is_public, nullif(trim(role_category), '') AS rc, canonical_opportunity_id AS opp, date_found AS fd, last_seen_at AS ld,
  salary_min_annual IS NOT NULL OR salary_max_annual IS NOT NULL AS priced, last_seen_at - posted_date AS life FROM jobs JOIN f_companies c USING (company_id)
  WHERE data_tier = 1 AND domain IS NOT NULL AND (loc_country IS NULL OR loc_country <> 'foreign') AND {US_PLACE}
  AND lower(company_name) NOT LIKE '%firm 77%' AND lower(company_name) NOT LIKE '%firm 5 inc%' AND lower(company_name) NOT LIKE '%firm 41 %'),
el AS (SELECT *, min(fd) OVER w AS o1, max(ld) OVER w AS o2, bool_or(is_public) OVER w AS op FROM el0 WINDOW w AS (PARTITION BY company_id, opp)),
sc AS (SELECT *, 'all' AS scope FROM el UNION ALL SELECT *, domain FROM el),
act AS (SELECT d, sc.* FROM sc JOIN days ON CASE WHEN d >= DATE '{as_of}' THEN is_public ELSE fd <= d AND ld >= d END),
am AS (SELECT d, company_id, scope, count(*) AS n, count(DISTINCT opp) AS o, count(DISTINCT opp) FILTER (WHERE o1 BETWEEN d - 6 AND d) AS nw, {r('count(*) FILTER (WHERE priced) * 100.0 / count(*)', 1)} AS tp FROM act GROUP BY 1, 2, 3),
cm AS (SELECT d, company_id, scope, {r('quantile_cont(life, 0.5) FILTER (WHERE life BETWEEN 2 AND 365)', 1)} AS med FROM sc JOIN days ON ld BETWEEN d - 89 AND d WHERE status = 'expired' GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE life BETWEEN 2 AND 365) >= 5),
dg AS (SELECT d, company_id, scope, count(DISTINCT opp) AS g FROM sc JOIN days ON o2 BETWEEN d - 6 AND d AND CASE WHEN d >= DATE '{as_of}' THEN NOT op ELSE true END GROUP BY 1, 2, 3),
rp AS (SELECT d, sc.company_id, scope, count(DISTINCT event_id) FILTER (WHERE signal_class = 'individual_repost_signal') AS ir, count(DISTINCT event_id) FILTER (WHERE signal_class = 'bulk_ats_date_refresh') AS br
  FROM sc JOIN reposts USING (job_id) JOIN days ON observed_on BETWEEN d - 29 AND d GROUP BY 1, 2, 3),
rc0 AS (SELECT d, company_id, scope, rc, count(DISTINCT opp) AS n FROM act WHERE rc IS NOT NULL GROUP BY 1, 2, 3, 4),
rm AS (SELECT d, company_id, scope, string_agg(concat(rc, ':', n), ';' ORDER BY n DESC, rc) AS role_mix FROM (SELECT *, row_number() OVER (PARTITION BY d, company_id, scope ORDER BY n DESC, rc) AS k FROM rc0) q WHERE k <= 5 GROUP BY 1, 2, 3),
cv AS (SELECT d, company_id, scope, min(fd) AS coverage_started_at FROM sc JOIN days ON fd <= d GROUP BY 1, 2, 3),
radar AS (SELECT d AS snapshot_date, company_id, scope, coalesce(o, 0) AS active_opportunities, coalesce(n, 0) AS active_source_postings, coalesce(nw, 0) AS new_opportunities_7d,
  coalesce(g, 0) AS disappeared_opportunities_7d, tp AS salary_transparency_pct, med AS median_closed_lifetime_days, coalesce(ir, 0) AS individual_repost_signals_30d, coalesce(br, 0) AS bulk_refresh_events_30d,
  coverage_started_at, coalesce(role_mix, '') AS role_mix, CASE WHEN d < DATE '{as_of}' THEN 'archive_reconstruction' ELSE 'live' END AS snapshot_source
  FROM cv LEFT JOIN am USING (d, company_id, scope) LEFT JOIN cm USING (d, company_id, scope) LEFT JOIN dg USING (d, company_id, scope) LEFT JOIN rp USING (d, company_id, scope) LEFT JOIN rm USING (d, company_id, scope))"""


def radar(t, first=FIRST):
    return K.radar_snapshot(S.jobs(t), t.companies, S.reposts(t), first, RADAR_DAY, RADAR_DAY, S.EXCLUSIONS)


def flat_mix(df):
    return df.withColumn("role_mix", F.coalesce(F.array_join(F.transform("role_mix", lambda m: F.concat_ws(":", m["role"], m["count"].cast("string"))), ";"), F.lit("")))


@query("bi_14_radar_snapshot", f"WITH {radar_sql(FIRST, RADAR_DAY, RADAR_DAY)} SELECT * FROM radar")
def _(t):
    return flat_mix(radar(t))


@query("bi_15_radar_history", f"WITH {radar_sql('2001-06-18', RADAR_DAY, RADAR_DAY)} SELECT snapshot_date, scope, count(*) AS companies, CAST(sum(active_opportunities) AS BIGINT) AS active_opportunities, CAST(sum(disappeared_opportunities_7d) AS BIGINT) AS gone FROM radar GROUP BY 1, 2")
def _(t):
    # No snapshot exists yet, so the whole history range is built in one job.
    none_yet = t.spark.createDataFrame([], "snapshot_date date")
    first = K.history_range(none_yet, RADAR_DAY).first()["first_day"]
    return radar(t, str(first)).groupBy("snapshot_date", "scope").agg(F.count(F.lit(1)).alias("companies"), F.sum("active_opportunities").alias("active_opportunities"), F.sum("disappeared_opportunities_7d").alias("gone"))


ALERTS = radar_sql(FIRST, RADAR_DAY, RADAR_DAY) + f""", nw AS (SELECT * FROM radar WHERE scope = 'all' AND snapshot_date = DATE '{RADAR_DAY}'), pr AS (SELECT company_id, active_opportunities AS prior FROM radar WHERE scope = 'all' AND snapshot_date = DATE '{RADAR_DAY}' - 7),
sg AS (SELECT nw.company_id, scope, 'hiring_surge' AS alert_type, active_opportunities AS value, prior AS reference FROM nw JOIN pr USING (company_id) WHERE coverage_started_at <= DATE '{RADAR_DAY}' - 14 AND prior >= 3 AND active_opportunities - prior >= 3 AND active_opportunities >= ceil(prior * 1.25)
 UNION ALL SELECT company_id, scope, 'fresh_roles', new_opportunities_7d, active_opportunities FROM nw WHERE coverage_started_at <= DATE '{RADAR_DAY}' - 7 AND new_opportunities_7d >= 5
 UNION ALL SELECT company_id, scope, 'repost_watch', individual_repost_signals_30d, NULL FROM nw WHERE individual_repost_signals_30d >= 2),
alerts AS (SELECT sg.*, DATE '{RADAR_DAY}' AS signal_date, user_id FROM sg JOIN f_follows USING (company_id) WHERE alert_frequency <> 'none')"""


@query("bi_16_radar_alerts", f"WITH {ALERTS} SELECT * FROM alerts")
def _(t):
    # The radar is written by day as it would be every night; the alerts read two of its days.
    path = scratch_path(t.spark, "radar")
    sinks.write_snapshot(radar(t), path, day_col="snapshot_date")
    daily = t.spark.read.parquet(path).filter(F.col("snapshot_date").isin(F.lit(RADAR_DAY).cast("date"), F.date_sub(F.lit(RADAR_DAY).cast("date"), 7)))
    return K.radar_alerts(daily, t.view("follows"), RADAR_DAY)


@query("bi_17_digest_batches", """WITH due AS (SELECT a.*, u.email FROM f_alerts a JOIN f_users u USING (user_id) WHERE signal_date >= DATE '2001-08-01' - 7 AND u.active AND u.email IS NOT NULL AND coalesce(email_enabled, true) AND coalesce(frequency, 'weekly') = 'weekly'
 AND EXISTS (SELECT 1 FROM f_follows f WHERE f.user_id = a.user_id AND f.company_id = a.company_id AND f.alert_frequency = 'weekly') AND alert_id NOT IN (SELECT alert_id FROM f_alerts WHERE delivered)
 AND a.user_id NOT IN (SELECT user_id FROM f_alerts WHERE delivered AND signal_date = DATE '2001-08-01' - 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY signal_date DESC, alert_id DESC) AS rn FROM due)
SELECT user_id, email, max(signal_date) AS newest_signal, string_agg(CAST(alert_id AS VARCHAR), ',' ORDER BY rn) AS alert_ids FROM k WHERE rn <= 20 GROUP BY 1, 2""")
def _(t):
    alerts = t.view("alerts")
    # Who got a digest the day before the last is taken for served today.
    served = alerts.filter(F.col("delivered") & (F.col("signal_date") == F.lit("2001-07-31").cast("date"))).select("user_id").distinct()
    out = K.digest_batches(alerts, t.view("users"), t.view("follows"), alerts.filter("delivered").select("alert_id"), served, "weekly", "2001-08-01")
    return out.withColumn("alert_ids", F.array_join(F.transform("alert_ids", lambda x: x.cast("string")), ","))


@query("bi_18_research_queue", f"""WITH {radar_sql(RADAR_DAY, RADAR_DAY, RADAR_DAY)}, st AS (SELECT company_id, max(posted_date) AS last_attempted_on FROM f_postings WHERE status = 'expired' GROUP BY 1),
fw AS (SELECT company_id, count(DISTINCT user_id) AS n FROM f_follows GROUP BY 1)
SELECT company_id, active_opportunities, new_opportunities_7d, company_name, last_attempted_on, coalesce(n, 0) AS follower_count FROM radar JOIN f_companies USING (company_id) LEFT JOIN fw USING (company_id) LEFT JOIN st USING (company_id)
WHERE scope = 'all' AND (last_attempted_on IS NULL OR last_attempted_on < DATE '{RADAR_DAY}' - 7) ORDER BY follower_count DESC, new_opportunities_7d DESC, active_opportunities DESC, company_id LIMIT 50""")
def _(t):
    state = t.postings.filter(F.col("status") == "expired").groupBy("company_id").agg(F.max("posted_date").alias("last_attempted_on"))
    return K.research_queue(radar(t, RADAR_DAY), t.companies, t.view("follows"), state, RADAR_DAY, 50)


GROWTH = radar_sql(FIRST, RADAR_DAY, RADAR_DAY) + f""", g AS (SELECT n.company_id, company_name, n.active_opportunities, n.new_opportunities_7d, n.individual_repost_signals_30d, n.active_opportunities - p.active_opportunities AS active_change_7d,
 CASE WHEN p.active_opportunities > 0 THEN {r('(n.active_opportunities - p.active_opportunities) * 100.0 / p.active_opportunities', 1)} END AS active_change_pct_7d
 FROM radar n JOIN radar p ON p.company_id = n.company_id AND p.scope = 'all' AND p.snapshot_date = DATE '{RADAR_DAY}' - 7 JOIN f_companies c ON c.company_id = n.company_id
 WHERE n.scope = 'all' AND n.snapshot_date = DATE '{RADAR_DAY}' AND n.active_opportunities >= 1 AND n.coverage_started_at <= DATE '{RADAR_DAY}' - 14)"""


@query("bi_30_growth_companies", f"WITH {GROWTH} SELECT * FROM g WHERE active_change_7d > 0 ORDER BY active_change_7d DESC, new_opportunities_7d DESC, company_id LIMIT 20")
def _(t):
    return M.growth_answer(radar(t), t.companies, "growth", min_active=1)


@query("bi_30_repost_companies", f"WITH {GROWTH} SELECT * FROM g WHERE individual_repost_signals_30d > 0 ORDER BY individual_repost_signals_30d DESC, active_opportunities DESC, company_id LIMIT 20")
def _(t):
    return M.growth_answer(radar(t), t.companies, "reposts", min_active=1)


@query("dup_8_preferred_name", "SELECT company_key, company_name FROM (SELECT regexp_replace(lower(company_name), '[^a-z0-9]+', '', 'g') AS company_key, company_name, row_number() OVER (PARTITION BY regexp_replace(lower(company_name), '[^a-z0-9]+', '', 'g') ORDER BY count(*) DESC, length(company_name) DESC, company_name) AS rn FROM f_postings JOIN f_companies USING (company_id) GROUP BY 1, 2) q WHERE rn = 1")
def _(t):
    named = t.postings.select("company_id").join(t.companies.select("company_id", "company_name", K.company_key(F.col("company_name")).alias("company_key")), "company_id")
    return K.preferred_name(named, "company_key", "company_name")
