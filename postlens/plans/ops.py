"""Operational reports: funnels, crawl health, tenants, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_id, rounded, trusted_us_location
from ..operators.filters import EXCLUSIONS, name_excluded
from ..operators.relational import dedupe_best

CLEAN = ("complete_nonzero", "complete_zero")  # fixed values: clean crawl outcomes
INVENTORY_TARGET = 100_000


def publication_funnel(postings: DataFrame, companies: DataFrame, exclusions: list[tuple[str, str]] = EXCLUSIONS) -> DataFrame:
    """Rows surviving each step from ingestion to publication, per source."""
    wide = postings.join(companies.select("company_id", "company_name"), "company_id", "left")
    active, tier1 = F.col("status") == "raw", (F.col("status") == "raw") & (F.col("data_tier") == 1)
    source, place = F.col("ingestion_source"), F.col("workplace_type")
    in_us = trusted_us_location(F.col("loc_country"), F.col("loc_state"), source, place)
    candidate = (
        F.col("loc_country").isin("US", "United States", "USA") | (F.col("loc_country").isNull() & F.col("loc_state").isNotNull())
        | trusted_us_location(F.col("loc_country"), F.lit("WA"), source, place) & (F.col("loc_country") == "unknown"))
    allowed = ~F.coalesce(name_excluded(F.col("company_name"), [(t, "substring") for t, _ in exclusions]), F.lit(False))
    visible = tier1 & F.col("domain").isNotNull() & F.col("role_id").isNotNull() & F.col("company_name").isNotNull() & allowed & in_us
    return wide.groupBy("ingestion_source").agg(
        F.count_if(active).alias("active_rows"), F.count_if(tier1).alias("tier1_rows"), F.count_if(tier1 & candidate).alias("us_candidate_rows"),
        F.count_if(tier1 & F.col("domain").isNotNull()).alias("classified_rows"), F.count_if(tier1 & F.col("domain").isNull()).alias("unresolved_domain_rows"),
        F.count_if(visible).alias("publishable_rows"), F.max("last_seen_at").alias("latest_seen_at"))


def domain_funnel(postings: DataFrame) -> DataFrame:
    return postings.filter((F.col("data_tier") == 1) & (F.col("status") == "raw")).groupBy("ingestion_source", F.coalesce("domain", F.lit("unresolved")).alias("domain")).agg(F.count(F.lit(1)).alias("jobs"))


def unresolved_titles(postings: DataFrame, roles: DataFrame) -> DataFrame:
    open_ = postings.filter((F.col("data_tier") == 1) & (F.col("status") == "raw") & F.col("domain").isNull())
    return open_.join(roles, "role_id").groupBy(F.lower(F.trim("role_name")).alias("normalized_title"), "ingestion_source").agg(
        F.count(F.lit(1)).alias("active_jobs"), F.max("last_seen_at").alias("last_seen_at"))


def scope_report(postings: DataFrame, roles: DataFrame, limit: int = 50) -> DataFrame:
    """Most frequent titles per admission outcome that is not accepted."""
    return postings.filter(~F.col("scope_status").startswith("accepted")).join(roles, "role_id").groupBy("scope_status", "role_name").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "scope_status", "role_name").limit(limit)


def _priced() -> Column:
    return F.col("salary_min_annual").isNotNull() | F.col("salary_max_annual").isNotNull()


def ops_inventory(jobs: DataFrame, as_of: str) -> DataFrame:
    day_ago = F.date_sub(F.lit(as_of).cast("date"), 1)
    return jobs.filter("is_public").groupBy(F.coalesce("ingestion_source", F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("public_jobs"), F.count_if(_priced()).alias("priced_jobs"), F.count_if(F.col("posted_date") >= day_ago).alias("new_24h"),
        F.count_if(F.col("experience_level").isNull()).alias("missing_level"),
        F.count_if(F.col("workplace_type").isNull() | F.lower("workplace_type").isin("unknown", "")).alias("missing_workplace"),
        F.max("last_seen_at").alias("last_seen"),
    ).withColumn("salary_pct", rounded(F.col("priced_jobs") * 100.0 / F.col("public_jobs"), 1))


def latest_orchestration(runs: DataFrame) -> DataFrame:
    """The attempts of the orchestration that started last; a run outside of any is left out."""
    newest = runs.filter(F.col("orchestration_id").isNotNull()).agg(F.max_by("orchestration_id", F.struct("started_on", "run_id")).alias("o"))
    return runs.filter(F.col("orchestration_id") == newest.scalar())


def crawl_rollup(runs: DataFrame, degraded: str | None = None) -> DataFrame:
    """Per source: the latest boundary decides the state, totals cover every attempt.

    A boundary flagged ``degraded`` is a partial failure even where no tenant failed.
    """
    boundary = dedupe_best(runs, ["source"], [F.col("checkpoint_sweep").desc(), F.col("started_on").desc(), F.col("run_id").desc()]).select(
        "source", F.col("crawl_status").alias("boundary_status"), F.col("finished_on").alias("boundary_finished"), F.col("errors").alias("boundary_errors"),
        (F.coalesce(F.col(degraded), F.lit(False)) if degraded else F.lit(False)).alias("boundary_degraded"))
    failed = tenant_failures(runs)
    totals = runs.groupBy("source").agg(F.sum("jobs_fetched").alias("fetched"), F.sum("jobs_written").alias("written"), F.bool_and(F.col("status").isin(*CLEAN)).alias("all_clean"))
    state = (
        F.when(F.col("boundary_finished").isNull(), "running")
        .when((F.col("boundary_errors") > 0) | ~F.col("boundary_status").isin(*CLEAN), "source_failure")
        .when(F.col("boundary_degraded") | (F.coalesce("failed_tenants", F.lit(0)) > 0), "partial_failure").otherwise(F.col("boundary_status")))
    return totals.join(boundary, "source").join(failed, "source", "left").select("source", "fetched", "written", "all_clean", F.coalesce("failed_tenants", F.lit(0)).alias("failed_tenants"), state.alias("state"))


def tenant_failures(runs: DataFrame) -> DataFrame:
    latest = dedupe_best(runs, ["source", "crawl_tenant"], [F.col("started_on").desc(), F.col("run_id").desc()])
    return latest.groupBy("source").agg(F.count_if(~F.col("status").isin(*CLEAN)).alias("failed_tenants"))


def report_state(crawl: DataFrame, published_at: Column, now: str, max_age_hours: int = 36, by: list[str] | None = None) -> DataFrame:
    """Healthy / In progress / Needs attention, one row (of each group ``by``).

    A publication over ``max_age_hours`` old needs attention; no crawl at all is no failure.
    """
    bad = F.count_if(F.col("state").isin("source_failure", "partial_failure"))
    running = F.count_if(F.col("state") == "running")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(published_at.cast("timestamp"))
    stale = published_at.isNull() | (age > max_age_hours * 3600)
    return crawl.groupBy(*(by or [])).agg(bad.alias("bad_sources"), running.alias("running_sources")).withColumn(
        "state", F.when(stale | (F.col("bad_sources") > 0), "Needs attention").when(F.col("running_sources") > 0, "In progress").otherwise("Healthy"))


def health_alerts(facts: DataFrame, queues: DataFrame, now: str, backlog_days: int = 7) -> DataFrame:
    """Alert rows from one row of measurements, and one row for each queue that is behind.

    ``queues`` has (queue, pending_since) of what was not delivered yet.
    """
    f = F.col
    rules = F.array_compact(F.array(
        F.when(F.coalesce(f("publication_age_hours"), F.lit(9999)) > 36, F.lit("published inventory is over 36 hours old")),
        F.when((f("host_attempts") > 0) & (f("host_failures") == f("host_attempts")), F.lit("all direct-host attempts failed")),
        F.when((f("recent_attempts") >= 5) & (f("recent_failures") >= f("recent_attempts") * 0.5), F.lit("direct-host failure rate is at least 50%")),
        F.when(f("expired_resumes") > 0, F.lit("resume retention overdue")),
    ))
    late = queues.groupBy("queue").agg(F.min("pending_since").alias("oldest")).filter(F.datediff(F.lit(now).cast("date"), "oldest") > backlog_days)
    return facts.select(F.explode(rules).alias("alert")).unionByName(late.select(F.concat("queue", F.lit(f" notification backlog exceeds {backlog_days} days")).alias("alert")))


def discovery_funnel(candidates: DataFrame, statuses: list[str]) -> DataFrame:
    """Tenant candidates per platform and status, with anomaly flags."""
    cells = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    out = candidates.groupBy("platform").agg(F.count(F.lit(1)).alias("total"), *cells)
    return out.withColumns({
        "pct_active": rounded(F.col("active") * 100.0 / F.col("total"), 0),
        "high_pending": F.col("pending") > 5000, "high_unreachable": (F.col("active") > 0) & (F.col("unreachable") > F.col("active") * 0.5)})


def recent_yield(postings: DataFrame, tenants: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Distinct postings seen lately for the registered tenants of each source."""
    seen = postings.filter(F.col("last_seen_at") >= F.date_sub(F.lit(as_of).cast("date"), days)).select("job_id", "ingestion_source", "crawl_tenant")
    token = F.when(F.col("source") == "workday", F.split_part("board_token", F.lit("/"), F.lit(1))).otherwise(F.col("board_token"))
    keyed = tenants.select(F.col("source").alias("ingestion_source"), token.alias("crawl_tenant")).distinct()
    return seen.join(keyed, ["ingestion_source", "crawl_tenant"], "left_semi").groupBy("ingestion_source").agg(F.countDistinct("job_id").alias("jobs_7d"))


def tenant_staleness(registry: DataFrame, observed: DataFrame, as_of: str, limit_days: int = 30) -> DataFrame:
    """Last sign of life per tenant across both sources of evidence."""
    wide = registry.join(observed, "crawl_tenant", "full")
    last = F.greatest("registry_seen", "posting_seen")
    return wide.select("crawl_tenant", last.alias("last_seen"), F.datediff(F.lit(as_of).cast("date"), last).alias("idle_days")).withColumn(
        "is_stale", F.col("idle_days").isNull() | (F.col("idle_days") > limit_days))


def employer_leads(postings: DataFrame, companies: DataFrame, limit: int) -> DataFrame:
    """Employers known only through the second tier, then dormant archives."""
    relevant = postings.filter(F.col("domain").isNotNull() | F.col("scope_status").startswith("accepted"))
    agg = relevant.groupBy("company_id").agg(
        F.count_if((F.col("data_tier") == 2) & (F.col("status") == "raw")).alias("tier2_jobs"), F.count_if(F.col("data_tier") == 1).alias("historical_tier1"),
        F.count_if((F.col("data_tier") == 1) & F.col("is_public")).alias("current_public"), F.max("last_seen_at").alias("last_seen"))
    leads = agg.filter((F.col("tier2_jobs") > 0) | ((F.col("historical_tier1") > 0) & (F.col("current_public") == 0)))
    only_second = F.when((F.col("tier2_jobs") > 0) & (F.col("historical_tier1") == 0), 0).otherwise(1)
    return leads.join(companies.select("company_id", "company_name"), "company_id").orderBy(
        only_second, F.greatest("tier2_jobs", "historical_tier1").desc(), F.col("last_seen").desc_nulls_last(), "company_id").limit(limit)


def integrate_candidates(candidates: DataFrame) -> DataFrame:
    """Registry rows for active tenant candidates, or the reason for skipping."""
    platform, tenant, server = F.col("platform"), F.col("tenant"), F.col("server")
    board = F.split_part(server, F.lit("/"), F.lit(2))
    token = (
        F.when(platform == "workday", F.when(server.isNotNull(), F.concat_ws("/", tenant, F.split_part(server, F.lit("/"), F.lit(1)), F.when(board == "", "External").otherwise(board))))
        .when(platform == "eightfold", F.when(server.isNotNull(), F.concat_ws("/", tenant, server)))
        .when(platform == "oracle_cloud", F.lit(None)).otherwise(tenant))
    reason = F.when(platform == "oracle_cloud", "needs_career_host").when(token.isNull(), "no_server")
    name = F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.initcap(F.replace(tenant, F.lit("-"), F.lit(" "))))
    return candidates.filter(F.col("status") == "active").select(
        "platform", "tenant", token.alias("board_token"), reason.alias("skip_reason"), name.alias("company_name"),
        F.when(token.isNotNull(), md5_id("AT", platform, token)).alias("registry_id"))


def eligible_reminders(applications: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Oldest undecided application per user, 7–21 days old, nobody reminded in the last week."""
    today = F.lit(as_of).cast("date")
    due = applications.filter(F.col("applied_on").between(F.date_sub(today, 21), F.date_sub(today, 7)) & F.col("outcome").isNull() & F.col("reminded_on").isNull())
    recent = applications.filter(F.col("reminded_on") > F.date_sub(today, 7)).select("user_id")
    ok = users.filter(F.col("active") & F.col("email").isNotNull() & F.coalesce("email_enabled", F.lit(True))).select("user_id", "email")
    return dedupe_best(due.join(recent, "user_id", "left_anti").join(ok, "user_id"), ["user_id"], [F.col("applied_on"), F.col("application_id")])


def eligible_nurture(signups: DataFrame, as_of: str, skip: tuple[str, ...] = ("@test.", "+test")) -> DataFrame:
    today = F.lit(as_of).cast("date")
    out = signups.filter((F.col("signed_up_on") < F.date_sub(today, 3)) & (F.col("signed_up_on") > F.date_sub(today, 7)) & F.col("upgraded_on").isNull()
                         & F.col("last_seen_on").isNotNull() & F.col("nurtured_on").isNull() & F.col("email").contains("@"))
    for part in skip:
        out = out.filter(~F.col("email").contains(part))
    return out


def host_report(hosts: DataFrame, visible: DataFrame, target: int = INVENTORY_TARGET) -> DataFrame:
    """Hosts and jobs per platform and status next to the gap to the inventory target."""
    seen = visible.agg(F.count(F.lit(1)).alias("n"))
    return hosts.groupBy("platform", "status").agg(F.count(F.lit(1)).alias("hosts"), F.sum("last_job_count").alias("jobs")).withColumn("visible_jobs", seen.scalar()).withColumn(
        "gap_to_target", F.greatest(F.lit(target) - F.col("visible_jobs"), F.lit(0)))


def candidates_by_status(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count(F.lit(1)).alias("candidates"))


def host_runs_total(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row: host runs of the last ``days`` and what they took in and turned down."""
    now = F.lit(as_of).cast("date")
    recent = runs.filter((F.col("started_on") >= F.date_sub(now, days)) & (F.col("started_on") <= now))
    sums = {"accepted": "accepted_jobs", "identity_mismatches": "identity_mismatches", "foreign_rejections": "foreign_rejections"}
    return recent.agg(F.count(F.lit(1)).alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def product_funnel(events: DataFrame, as_of: str, days: int = 30, retention: int = 90) -> DataFrame:
    """Distinct accounts per milestone in the last ``days``; older than ``retention`` is ignored."""
    now = F.lit(as_of).cast("date")
    kept = events.filter(F.col("ts").cast("date") >= F.date_sub(now, retention))
    return kept.filter(F.col("ts").cast("date") > F.date_sub(now, days)).groupBy("event_type").agg(F.countDistinct("user_id").alias("accounts"))


def board_tenant(source: Column, token: Column) -> Column:
    """The tenant part of a board's token: for one source the token goes on after a slash."""
    return F.when(source == "workday", F.split_part(token, F.lit("/"), F.lit(1))).otherwise(token)


def refresh_registry(registry: DataFrame, postings: DataFrame) -> DataFrame:
    """Active role counts per registered board; boards without raw postings drop to zero."""
    counts = postings.filter((F.col("status") == "raw") & F.col("crawl_tenant").isNotNull()).groupBy(F.col("ingestion_source").alias("source"), F.col("crawl_tenant").alias("_tenant")).agg(F.count(F.lit(1)).alias("_n"))
    keyed = registry.withColumn("_tenant", board_tenant(F.col("source"), F.col("board_token")))
    return keyed.join(counts, ["source", "_tenant"], "left").withColumn("active_roles", F.coalesce("_n", F.lit(0))).drop("_n", "_tenant")


def registry_summary(refreshed: DataFrame) -> DataFrame:
    """Boards, boards with roles and open roles per source."""
    return refreshed.groupBy("source").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("active_roles") > 0).alias("with_roles"), F.sum("active_roles").alias("open_roles"))
