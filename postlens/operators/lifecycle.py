"""Posting lifecycle as state differences between frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import dedupe_best

CLEAN = ("complete_nonzero", "complete_zero")  # fixed values: clean crawl outcomes
MATURE_DAYS, FAST_DAYS = 7, 2


def lifecycle_events(previous: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Appeared / reappeared events caused by observing ``batch``."""
    today = F.lit(as_of).cast("date")
    state = previous.select("job_id", F.col("status").alias("_status"), F.col("last_seen_at").alias("_seen"))
    joined = batch.select("job_id", "posted_date").join(state, "job_id", "left")
    kind = F.when(F.col("_status").isNull(), "appeared").when(F.col("_status") == "expired", "reappeared")
    return joined.withColumn("event_type", kind).filter(F.col("event_type").isNotNull()).select(
        "job_id", "event_type", today.alias("observed_on"), "posted_date",
        F.when(F.col("event_type") == "reappeared", F.datediff(today, "_seen")).alias("gap_days"))


def clean_tenants(runs: DataFrame) -> DataFrame:
    """Tenants whose latest attempt, and the crawl around it, were clean."""
    latest = dedupe_best(runs, ["source", "crawl_tenant"], [F.col("started_on").desc(), F.col("run_id").desc()])
    return latest.filter(F.col("status").isin(*CLEAN) & F.col("crawl_status").isin(*CLEAN) & (F.col("errors") == 0)).select("source", "crawl_tenant")


def expire(postings: DataFrame, tenants: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(postings with new status, events): unseen for a day and the tenant clean → expired;
    expired but seen again → active."""
    today = F.lit(as_of).cast("date")
    cutoff = F.date_sub(today, 1)
    flagged = postings.join(
        tenants.select(F.col("source").alias("ingestion_source"), "crawl_tenant", F.lit(True).alias("_clean")), ["ingestion_source", "crawl_tenant"], "left")
    tier1 = F.col("data_tier") == 1
    gone = tier1 & (F.col("status") != "expired") & F.col("_clean").isNotNull() & (F.col("last_seen_at") < cutoff)
    back = tier1 & (F.col("status") == "expired") & (F.col("last_seen_at") >= cutoff)
    marked = flagged.withColumn("_event", F.when(gone, "disappeared").when(back, "reappeared"))
    after = marked.withColumns({
        "status": F.when(F.col("_event") == "disappeared", "expired").when(F.col("_event") == "reappeared", "raw").otherwise(F.col("status")),
        "expired_reason": F.when(F.col("_event") == "disappeared", "natural_cron").when(F.col("_event").isNull(), F.col("expired_reason")),
    }).select(*postings.columns)
    events = marked.filter(F.col("_event").isNotNull()).select(
        "job_id", F.col("_event").alias("event_type"), F.when(F.col("_event") == "disappeared", F.col("last_seen_at")).otherwise(today).alias("observed_on"),
        F.when(F.col("_event") == "reappeared", F.datediff(today, "last_seen_at")).alias("gap_days"))
    return after, events


def expire_host(postings: DataFrame, source: str, tenant: str, run_start: str) -> DataFrame:
    """Postings of one host that its finished crawl did not see again."""
    missed = (F.col("ingestion_source") == source) & (F.col("crawl_tenant") == tenant) & (F.col("status") == "raw") & (F.col("last_seen_at") < F.lit(run_start).cast("date"))
    return postings.filter(missed).withColumns({"status": F.lit("expired"), "expired_reason": F.lit("career_host_closed")})


def merge_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per tenant from all its attempts."""
    bad, failed, n = F.col("status") == "partial_failure", F.col("status") == "failed", F.col("jobs_fetched")
    agg = outcomes.groupBy("source", "crawl_tenant").agg(
        F.bool_or(bad).alias("_partial"), F.bool_or(failed).alias("_some"), F.bool_and(failed).alias("_all"),
        F.max(n).alias("jobs_fetched"), F.sum("errors").alias("errors"), F.max_by("detail", F.struct("started_on", "run_id")).alias("detail"))
    status = (
        F.when(F.col("_partial") | (F.col("_some") & ~F.col("_all")), "partial_failure").when(F.col("_all"), "failed")
        .when(F.col("jobs_fetched") > 0, "complete_nonzero").otherwise("complete_zero"))
    return agg.select("source", "crawl_tenant", status.alias("status"), "jobs_fetched", "errors", "detail")


# Shares up to which a run counts as clean.
MISMATCH_SHARE, BRAND_SHARE = 0.01, 0.25


def host_run_outcome(runs: DataFrame) -> DataFrame:
    """Adds status and clean to runs of direct hosts.

    ``runs`` has jobs, target_jobs, errors, identity_mismatches, host_jobs, brand_jobs and,
    null where a run did not read sitemaps by their roots, sitemap_roots and
    sitemap_child_errors, else sitemap_errors.  A run is complete without errors of its own and
    of its sitemaps; it is clean if it is complete, found jobs, mismatched next to none, and
    does not live on jobs that only a brand name ties to the host.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    targets = F.greatest(zero("target_jobs"), F.lit(1))
    sitemaps = F.when(F.col("sitemap_child_errors").isNotNull(), (zero("sitemap_roots") > 0) & (F.col("sitemap_child_errors") == 0)).otherwise(zero("sitemap_errors") == 0)
    complete = (zero("errors") == 0) & sitemaps
    few = zero("identity_mismatches") / targets <= MISMATCH_SHARE
    backed = (zero("brand_jobs") == 0) | ((zero("host_jobs") > 0) & (zero("brand_jobs") / targets <= BRAND_SHARE))
    status = (
        F.when(~complete, "partial_failure").when((zero("target_jobs") > 0) & ~few, "quality_rejected")
        .when(zero("jobs") > 0, "complete_nonzero").otherwise("complete_zero"))
    return runs.withColumns({"status": status, "clean": (zero("jobs") > 0) & complete & few & backed})


def mature_hosts(hosts: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Shadow hosts become active after a clean crawl and enough age.

    ``runs`` has (host_id, ran_on, clean, jobs, mismatches).
    """
    today = F.lit(as_of).cast("date")
    facts = runs.groupBy("host_id").agg(
        F.min(F.when(F.col("clean"), F.col("ran_on"))).alias("first_clean"), F.max_by(F.struct("clean", "jobs", "mismatches"), F.struct("ran_on", "run_id")).alias("_last"))
    j = hosts.join(facts, "host_id", "left")
    fast = (F.col("_last.jobs") > 0) & (F.col("_last.mismatches") == 0) & (F.datediff(today, "first_clean") >= FAST_DAYS)
    needed = F.when(F.coalesce(fast, F.lit(False)), FAST_DAYS).otherwise(MATURE_DAYS)
    ready = (F.col("status") == "shadow") & F.coalesce(F.col("_last.clean"), F.lit(False)) & (F.datediff(today, "created_on") >= needed)
    return j.withColumn("days_needed", needed).withColumn("status", F.when(ready, "active").otherwise(F.col("status"))).drop("_last", "first_clean")
