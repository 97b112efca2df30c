"""Gates and expectations; each returns the violations as a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import US_STATES, blank_to_null, slug
from .filters import EXCLUSIONS, NOT_HIRING_TEXT, ROLE_LIKE_NAME, TALENT_POOL_TITLE, name_excluded
from .relational import dedupe_best

# Fixed values of the publication gate.
FRESH_DAYS, MIN_TEXT, FLOOR_RATIO = 3, 100, 0.70
SOURCE_RANK = ["employer_feed", "career_site", "oracle_cloud", "greenhouse", "ashby", "lever", "workday"]
CLEAN = ("complete_nonzero", "complete_zero")


def publication_candidates(postings: DataFrame, companies: DataFrame, roles: DataFrame, as_of: str,
                           exclusions: list[tuple[str, str]] = EXCLUSIONS) -> DataFrame:
    """Eligible postings, one per canonical opportunity.

    Where the table has them, ``valid_through`` must not be over and ``location_evidence``
    (a map or struct as JSON text) must say something.
    """
    f, today = F.col, F.lit(as_of).cast("date")
    in_us = F.upper(F.coalesce("loc_state", F.lit(""))).isin(US_STATES)
    country = F.lower(F.coalesce("loc_country", F.lit("")))
    place = (country.isin("us", "united states", "usa") & (blank_to_null(f("loc_state")).isNull() | in_us)) | (country.isin("", "unknown") & in_us)
    text = F.coalesce("description_text", F.lit(""))
    ok = (
        (f("status") == "raw") & (f("data_tier") == 1) & (F.coalesce("ingestion_source", F.lit("")) != "adzuna")
        & f("scope_status").isin("accepted_core", "accepted_evidence") & f("role_id").isNotNull() & f("domain").isNotNull() & f("role_category").isNotNull()
        & f("experience_level").isNotNull() & f("has_embedding") & (F.length(text) >= MIN_TEXT) & blank_to_null(f("crawl_tenant")).isNotNull()
        & (f("last_seen_at") >= F.date_sub(today, FRESH_DAYS)) & (f("posted_date") <= today) & f("job_url").rlike("(?i)^https?://")
        & (F.coalesce("source_quality_status", F.lit("active")) == "active") & ~text.rlike(NOT_HIRING_TEXT) & place)
    if "valid_through" in postings.columns:
        ok = ok & (f("valid_through").isNull() | (f("valid_through") >= today))
    if "location_evidence" in postings.columns:
        ok = ok & ~F.trim(F.coalesce(f("location_evidence"), F.lit(""))).isin("", "{}")
    names = companies.filter(~F.coalesce(name_excluded(f("company_name"), exclusions), F.lit(False)) & ~f("company_name").rlike(ROLE_LIKE_NAME)
                             & ~f("company_name").rlike(r"(?i)\|wd[0-9]+\|")).select("company_id")
    titles = roles.filter(~f("role_name").rlike(TALENT_POOL_TITLE)).select("role_id")
    rank = reduce(lambda acc, i: acc.when(f("ingestion_source") == SOURCE_RANK[i], i), range(1, len(SOURCE_RANK)), F.when(f("ingestion_source") == SOURCE_RANK[0], 0)).otherwise(len(SOURCE_RANK))
    # Only what the ranking needs travels through the shuffle: a length, not a text.
    slim = postings.filter(ok).join(names, "company_id", "left_semi").join(titles, "role_id", "left_semi").select(
        F.coalesce(blank_to_null(f("canonical_opportunity_id")), f("job_id")).alias("canonical_opportunity_id"), "job_id", "posted_date", "last_seen_at",
        rank.alias("_src"), F.length(text).alias("_len"))
    return dedupe_best(slim, ["canonical_opportunity_id"], [f("_src"), f("_len").desc(), f("posted_date").desc_nulls_last(), f("last_seen_at").desc_nulls_last(), f("job_id")]).select("canonical_opportunity_id", "job_id")


class PublicationRefused(RuntimeError):
    """Too few candidates to replace the published set."""


def publish(postings: DataFrame, candidates: DataFrame, roles: DataFrame, minimum: int, floor: float = FLOOR_RATIO, base_url: str = "https://example.com/openings") -> dict[str, DataFrame]:
    """Difference between the published set and the candidates, or a refusal.

    The counts are the one action before any write.
    """
    live = postings.filter("is_public").select("job_id")
    prior, n = live.count(), candidates.count()
    required = max(minimum, int(prior * floor)) if prior else minimum
    if n < required:
        raise PublicationRefused(f"{n} candidates, {required} required (published now: {prior})")
    both = live.withColumn("_old", F.lit(True)).join(candidates.select("job_id").withColumn("_new", F.lit(True)), "job_id", "full")
    changes = both.filter(F.col("_old").isNull() | F.col("_new").isNull()).select("job_id", F.when(F.col("_new").isNull(), "URL_DELETED").otherwise("URL_UPDATED").alias("notification_type"))
    queue = changes.join(postings.select("job_id", "role_id"), "job_id").join(roles, "role_id", "left").select(
        "job_id", "notification_type", F.concat_ws("/", F.lit(base_url), "job_id", slug(F.coalesce("role_name", F.lit("")))).alias("url"))
    run = changes.agg(F.count_if(F.col("notification_type") == "URL_UPDATED").alias("activated"), F.count_if(F.col("notification_type") == "URL_DELETED").alias("deactivated")).select(
        F.lit(prior).alias("prior_count"), F.lit(n).alias("candidate_count"), "activated", "deactivated")
    return {"changes": changes, "queue": queue, "run": run}


def guard_published_flag(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose published flag was changed by anyone but the publisher."""
    return old.select("job_id", F.col("is_public").alias("_was")).join(new.select("job_id", "is_public"), "job_id").filter(~F.col("_was").eqNullSafe(F.col("is_public"))).select("job_id", "is_public")


# Columns whose change counts as a change of content.
CONTENT_COLUMNS = ["description_text", "role_id", "company_id", "job_url", "posted_date", "workplace_type", "experience_level", "loc_city", "loc_state", "loc_country", "is_public"]


def track_content_update(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Stamp new and changed rows; unchanged rows keep their old stamp."""
    def mark(df: DataFrame) -> Column:
        return F.sha2(F.to_json(F.struct(*CONTENT_COLUMNS), {"ignoreNullFields": "false"}), 256)
    prior = old.select("job_id", mark(old).alias("_h"), "content_updated_on")
    joined = new.drop("content_updated_on").withColumn("_now", mark(new)).join(prior, "job_id", "left")
    return joined.withColumn("content_updated_on", F.when(F.col("_h") == F.col("_now"), F.col("content_updated_on")).otherwise(F.lit(as_of).cast("date"))).drop("_h", "_now")


def ingest_gate(runs: DataFrame, postings: DataFrame, expected: list[str], since: str) -> DataFrame:
    """(source, violation) rows; an empty frame means the gate is open."""
    spark = runs.sparkSession
    want = spark.createDataFrame([(s,) for s in expected], "source string")
    agg = runs.groupBy("source").agg(F.bool_and(F.col("status").isin(*CLEAN)).alias("_all"), F.count_if(F.col("finished_on").isNull()).alias("_running"), F.sum("jobs_written").alias("_written"))
    edge = dedupe_best(runs, ["source"], [F.col("checkpoint_sweep").desc(), F.col("started_on").desc(), F.col("run_id").desc()])
    # The latest whole-inventory boundary overrides the roll-up of the attempts.
    edge = edge.select("source", (F.col("crawl_status").isin(*CLEAN) & (F.col("errors") == 0)).alias("_ok"), F.col("finished_on").isNull().alias("_open"))
    rows = postings.filter((F.col("data_tier") == 1) & (F.col("last_seen_at") >= F.lit(since).cast("date"))).groupBy(F.col("ingestion_source").alias("source")).agg(F.count(F.lit(1)).alias("_rows"))
    j = want.join(agg, "source", "left").join(edge, "source", "left").join(rows, "source", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("_ok").isNull(), F.lit("never_ran")), F.when(~F.col("_ok"), F.lit("incomplete")), F.when(F.col("_open"), F.lit("still_running")),
        F.when((F.coalesce("_written", F.lit(0)) > 0) & (F.coalesce("_rows", F.lit(0)) == 0), F.lit("no_current_rows"))))
    return j.select("source", F.explode(problems).alias("violation"))


def expect_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in cols]))
    return df.select(F.explode(bad).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def expect_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def expect_accepted(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(values)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def expect_relationship(child: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    return child.filter(F.col(col).isNotNull()).join(parent.select(F.col(key).alias(col)), col, "left_anti").groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def expect_expression(df: DataFrame, name: str, condition: Column) -> DataFrame:
    bad = df.filter(~F.coalesce(condition, F.lit(True)))
    return bad.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(F.lit(name).alias("violation"), "n")


def audit_distribution(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """Before/after cross table of a reclassification, disagreements included."""
    joined = old.select(key, F.col(col).alias("before")).join(new.select(key, F.col(col).alias("after")), key, "full")
    return joined.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))
