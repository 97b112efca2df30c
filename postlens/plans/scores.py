"""Posting scores: repost classification, stale-posting risk, honesty, difficulty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded, share
from ..operators.relational import dedupe_best, latest_before, min_sample, with_group_facts
from ..session import cut_lineage
from .core import in_band, median

# Fixed values of the stale-posting risk model.
RISK_WEIGHTS = {"age": 0.65, "reappearance": 0.20, "repost": 0.15}
RISK_PER_REAPPEARANCE = 25.0
RISK_PER_REPOST = 12.5
RISK_TIERS = [("high", 75), ("medium", 50), ("low", 25)]
MIN_CLOSURES = 20
CLOSURE_DAYS = (3, 365)
DATES_AFTER = "2020-01-01"
BULK_COHORT = 5

# Fixed values of the hiring difficulty model.
NICHE_SHARE = 0.05
DIFFICULTY_WEIGHTS = {"rarity": 0.30, "complexity": 0.25, "salary_below": 0.30, "opacity": 0.15}


def classify_reposts(events: DataFrame, postings: DataFrame, day_bucket: str = "month") -> DataFrame:
    """Reappearances with a newer date than the last disappearance, by likely cause."""
    log = events.select("event_id", "job_id", "observed_at", "posted_date", "event_type").filter(
        F.col("event_type").isin("disappeared", "reappeared"))
    paired = latest_before(log, "job_id", "observed_at", F.col("event_type") == "disappeared", ["posted_date"],
                           F.date_trunc(day_bucket, F.col("observed_at").cast("timestamp")))
    back = paired.filter((F.col("event_type") == "reappeared") & (F.col("posted_date") > F.col("prior_posted_date")))
    rows = back.join(postings.select("job_id", "ingestion_source", "company_id", "role_id"), "job_id").withColumns({
        "observed_on": F.col("observed_at").cast("date"),
        "gap_us": F.unix_micros(F.col("observed_at").cast("timestamp")) - F.unix_micros(F.col("prior_observed_at").cast("timestamp")),
    })
    cohorts = with_group_facts(rows, ["company_id", "ingestion_source", "observed_on", "posted_date"], same_refresh_cohort=F.count(F.lit(1)))
    day_us = 86_400_000_000
    return cohorts.withColumns({
        "gap_days": F.floor(F.col("gap_us") / day_us),
        "signal_class": F.when(F.col("same_refresh_cohort") >= BULK_COHORT, "bulk_ats_date_refresh")
        .when(F.col("gap_us") < day_us, "crawler_churn").otherwise("individual_repost_signal"),
    }).drop("event_type", "gap_us")


def ghost_index(postings: DataFrame, companies: DataFrame, roles: DataFrame, reposts: DataFrame, as_of: str,
                dates_after: str = DATES_AFTER) -> DataFrame:
    """Explainable risk that an active posting is stale."""
    posted, after = F.col("posted_date"), F.lit(dates_after).cast("date")
    sectors = companies.select("company_id", "company_name", "sector")
    life = F.datediff(F.col("last_seen_at").cast("date"), "posted_date")
    closures = (
        postings.filter((F.col("status") == "expired") & (F.col("expired_reason") == "natural_cron")
                        & (posted > after) & life.between(*CLOSURE_DAYS))
        .select("company_id", "ingestion_source", life.alias("days")).join(sectors, "company_id", "left")
    )
    # Days are whole numbers in a fixed range: one row per (source, sector, days)
    # carries everything the three baselines need.
    histogram = closures.groupBy("sector", "ingestion_source", "days").agg(F.count(F.lit(1)).alias("n"))

    def baseline(keys: list[str], tag: str) -> DataFrame:
        agg = histogram.groupBy(*keys).agg(
            F.percentile("days", 0.5, F.col("n")).alias(f"{tag}_median"), F.sum("n").alias(f"{tag}_n"))
        return agg if not keys else min_sample(agg, MIN_CLOSURES, f"{tag}_n")

    by_pair = baseline(["sector", "ingestion_source"], "pair")
    by_sector = baseline(["sector"], "sector").withColumnRenamed("sector_n", "sec_n").withColumnRenamed("sector_median", "sec_median")
    overall = baseline([], "all")
    signals = (
        reposts.filter(F.col("signal_class") == "individual_repost_signal").groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("_re"), F.max("gap_days").alias("longest_gap_days"))
    )
    related = postings.filter(F.col("canonical_opportunity_id").isNotNull()).groupBy("canonical_opportunity_id").agg(
        (F.countDistinct("job_id") - 1).alias("_rel"), F.countDistinct("ingestion_source").alias("_srcs"))
    active = (
        postings.filter((F.col("data_tier") == 1) & (F.col("status") == "raw") & F.col("role_id").isNotNull()
                        & F.coalesce("loc_country", F.lit("unknown")).isin("US", "unknown"))
        .select("job_id", "company_id", "role_id", "ingestion_source", "posted_date", "canonical_opportunity_id")
        .join(sectors, "company_id", "left").join(roles, "role_id", "left")
        .join(by_pair, ["sector", "ingestion_source"], "left").join(by_sector, "sector", "left")
        .join(signals, "job_id", "left").join(related, "canonical_opportunity_id", "left")
        .withColumns({"all_median": overall.select("all_median").scalar(), "all_n": overall.select("all_n").scalar()})
    )
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), posted), F.lit(0))
    base = F.coalesce("pair_median", "sec_median", "all_median")
    shaped = active.withColumns({
        "days_open_raw": age, "days_open_capped": F.least(age, F.lit(CLOSURE_DAYS[1])), "baseline_days": base,
        "baseline_sample_size": F.coalesce("pair_n", "sec_n", "all_n", F.lit(0)),
        "baseline_type": F.when(F.col("pair_median").isNotNull(), "source_sector").when(F.col("sec_median").isNotNull(), "sector")
        .when(F.col("all_median").isNotNull(), "global"),
        "reappearance_count": F.coalesce("_re", F.lit(0)), "related_posting_count": F.coalesce("_rel", F.lit(0)),
        "related_source_count": F.coalesce("_srcs", F.lit(0)),
    })
    ratio = F.col("days_open_capped") / F.nullif(F.col("baseline_days"), F.lit(0.0))
    risks = shaped.withColumns({
        "_age": F.when((posted > after) & F.col("baseline_days").isNotNull(), (1 - 1 / (1 + ratio * ratio)) * 100),
        "reappearance_risk": F.least(F.col("reappearance_count") * RISK_PER_REAPPEARANCE, F.lit(100.0)),
        "repost_risk": F.least(F.col("related_posting_count") * RISK_PER_REPOST, F.lit(100.0)),
    })
    silent = F.col("_age").isNull() & (F.col("reappearance_count") == 0) & (F.col("related_posting_count") == 0)
    score = F.coalesce("_age", F.lit(0.0)) * RISK_WEIGHTS["age"] + F.col("reappearance_risk") * RISK_WEIGHTS["reappearance"] \
        + F.col("repost_risk") * RISK_WEIGHTS["repost"]
    scored = risks.withColumn("ghost_probability", F.when(~silent, rounded(score, 1)))
    p, n = F.col("ghost_probability"), F.col("baseline_sample_size")
    tier = F.when(p.isNull(), "unscored")
    for name, floor in RISK_TIERS:
        tier = tier.when(p >= floor, name)
    return scored.select(
        "job_id", "company_id", "company_name", "sector", "role_name", "ingestion_source", "posted_date",
        "days_open_raw", "days_open_capped", rounded(F.col("baseline_days"), 0).alias("baseline_days"), "baseline_type",
        "baseline_sample_size", rounded(F.col("_age"), 1).alias("age_risk"), "reappearance_count", "longest_gap_days",
        "reappearance_risk", "related_posting_count", "related_source_count", "repost_risk", "ghost_probability",
        tier.otherwise("fresh").alias("ghost_tier"),
        F.when(p.isNull(), "low").when((n >= 100) & posted.isNotNull(), "high")
        .when((n >= 20) | (F.col("reappearance_count") > 0) | (F.col("related_posting_count") > 0), "medium")
        .otherwise("low").alias("score_confidence"),
    )


# Level buckets, plausibility ladder and weights by (group, level).
LEVEL_BUCKETS = [("entry", ["entry"]), ("associate", ["associate", "junior"]), ("mid", ["mid", "intermediate"]),
                 ("senior", ["senior", "lead", "principal", "staff"])]
PREFERRED_WEIGHT = 0.35
DEFAULT_GROUP_WEIGHTS = {("G1", "any"): 1.2, ("G2", "any"): 0.9, ("G3", "entry"): 1.5, ("G3", "any"): 1.1, ("G5", "mid"): 0.8}
STACK_LADDER = [("entry", 7.5, 22), ("entry", 5.5, 14), ("entry", 4.0, 8), ("associate", 8.5, 14), ("associate", 6.5, 8), ("mid", 10.0, 8)]


def level_bucket(level: Column) -> Column:
    out = None
    for name, members in LEVEL_BUCKETS:
        out = (F if out is None else out).when(level.isin(members), name)
    return out.otherwise("unknown")


def plausibility(postings: DataFrame, job_skills: DataFrame, skills: DataFrame,
                 weights: dict[tuple[str, str], float] = DEFAULT_GROUP_WEIGHTS,
                 groups: tuple[str, str, str] = ("G1", "G2", "G3")) -> DataFrame:
    """Penalty for skill stacks that do not fit the advertised level, set-based.

    ``groups`` names the (data engineering, modelling, cloud) skill groups.
    """
    pairs = job_skills.select("job_id", "skill_id", F.lower("skill_priority").alias("skill_priority")).join(
        skills.select("skill_id", "group_id"), "skill_id", "left")
    required, preferred = F.col("skill_priority") == "required", F.col("skill_priority") == "preferred"
    group, level = F.col("group_id"), F.col("level_bucket")
    levelled = pairs.join(postings.select("job_id", level_bucket(F.coalesce("experience_level", F.lit(""))).alias("level_bucket")), "job_id")
    exact = F.lit(None).cast("double")
    for (g, bucket), w in weights.items():
        if bucket != "any":
            exact = F.when((group == g) & (level == bucket), F.lit(w)).otherwise(exact)
    general = F.lit(None).cast("double")
    for (g, bucket), w in weights.items():
        if bucket == "any":
            general = F.when(group == g, F.lit(w)).otherwise(general)
    weight = F.coalesce(exact, general, F.lit(1.0))
    points = F.when(group.isNotNull(), F.when(required, weight).when(preferred, weight * PREFERRED_WEIGHT)).otherwise(0.0)
    de, ml, cloud = groups
    stats = levelled.groupBy("job_id", "level_bucket").agg(
        F.count_if(required).alias("required_skills"), F.count_if(preferred).alias("preferred_skills"),
        rounded(F.coalesce(F.sum(points), F.lit(0.0)), 4).alias("seniority_points"),
        *[F.count_if(required & (group == g)).alias(n) for g, n in ((de, "req_de"), (ml, "req_ml"), (cloud, "req_cloud"))],
    )
    everyone = postings.select("job_id", level_bucket(F.coalesce("experience_level", F.lit(""))).alias("level_bucket"))
    full = everyone.join(stats.drop("level_bucket"), "job_id", "left").na.fill(
        0, ["required_skills", "preferred_skills", "seniority_points", "req_de", "req_ml", "req_cloud"])
    pts, req = F.col("seniority_points"), F.col("required_skills")
    ladder = None
    for bucket, floor, penalty in STACK_LADDER:
        ladder = (F if ladder is None else ladder).when((level == bucket) & (pts >= floor), penalty)
    entry = level == "entry"
    spread = entry & (F.col("req_de") >= 1) & (F.col("req_ml") >= 1) & (F.col("req_cloud") >= 1)
    scope = F.when(entry & (req >= 12), 10).when(entry & (req >= 9), 6).when(level.isin("associate", "mid") & (req >= 14), 6).otherwise(0)
    mix = F.when(spread, 10).when(entry & (F.col("req_ml") >= 2), 6).otherwise(0)
    return full.withColumns({
        "plausibility_penalty": F.least(ladder.otherwise(0) + scope + mix, F.lit(25)),
        "plausibility_flags": F.array_compact(F.array(
            F.when(entry & (pts >= 5.5), F.lit("entry_senior_stack")), F.when(entry & (req >= 9), F.lit("entry_fullstack_scope")),
            F.when(spread, F.lit("entry_cross_discipline")), F.when((level == "associate") & (pts >= 8.5), F.lit("associate_senior_stack")))),
    })


# Fixed patterns: phrases the honesty score looks for (case-insensitive).
COY_PAY = r"(?i)\b(doe|competitive|commensurate)\b"
YEARS_PLUS = r"(?i)\b\d+\+\s*(years|yrs)\b"
OVERLOAD = [r"(?i)\bon[- ]call\b", r"(?i)\blean team\b", r"(?i)\bfast[- ]paced\b"]
ONSITE_TALK = r"(?i)\b(on[- ]?site|onsite|in office)\b"
SENIOR_TITLE = r"(?i)\b(senior|sr\.|lead|principal|staff)\b"
INFLATED_TITLE = r"(?i)\b(senior|sr\.|lead|principal|staff|director|vp|head of)\b"
EXECUTIVE_TITLE = r"(?i)\b(director|vp|vice president|head of)\b"
# Own definition: the stock phrases that say nothing about the job, each with words it holds in any case.
VAGUE_PHRASES = {"rock ?star": "star", "ninja": "ninja", "wear many hats": "many hats", "self[- ]starter": "starter", "work hard,? play hard": "play hard", "every applicant": "every applicant"}


def honesty_score(postings: DataFrame, companies: DataFrame, roles: DataFrame, fit: DataFrame) -> DataFrame:
    """Eight capped penalties from 100, with the reasons as flags."""
    text, small = F.col("description_text"), F.col("_small")

    def found(pattern: str, *words: str) -> Column:
        """Whether a pattern matches; texts in lower case without any of its ``words`` need no search."""
        return reduce(or_, [small.contains(w) for w in words]) & text.rlike(pattern)

    eeo_at = F.instr(small, "equal opportunity employer")
    # A text is read before the joins, and only what was found in it goes through them.
    jobs = (
        postings.filter((F.coalesce("data_tier", F.lit(1)) == 1) & (F.col("status") == "raw") & (F.length("description_text") > 100))
        .withColumn("_small", F.lower(text)).select(
            "job_id", "role_id", "experience_level", "workplace_type", "salary_min", "salary_max", "salary_period",
            found(COY_PAY, "doe", "competitive", "commensurate").alias("_coy"), text.rlike(YEARS_PLUS).alias("_years"), found(ONSITE_TALK, "site", "in office").alias("_onsite"),
            (found(OVERLOAD[1], "lean team") & found(OVERLOAD[0], "call") & found(OVERLOAD[2], "paced")).alias("_overload"),
            ((eeo_at > 0) & (F.length(text) > 4000) & ((F.length(text) - eeo_at + 1) / F.length(text) > 0.40)).alias("_eeo"),
            sum((F.when(found(f"(?i){p}", word), 1).otherwise(0) for p, word in VAGUE_PHRASES.items()), F.lit(0)).alias("_vague_hits"))
        .join(roles, "role_id", "left").join(fit.drop("level_bucket"), "job_id", "left")
    )
    title = F.coalesce("role_name", F.lit(""))
    level, place = F.coalesce("experience_level", F.lit("unknown")), F.coalesce("workplace_type", F.lit("unknown"))
    low, high = F.col("salary_min"), F.col("salary_max")
    req = F.coalesce("required_skills", F.lit(0))
    no_pay, some_pay = low.isNull() & high.isNull(), low.isNotNull() | high.isNotNull()
    wide = F.coalesce((low > 0) & (high / low >= 2.5), F.lit(False))
    no_period = some_pay & (F.coalesce(F.trim("salary_period"), F.lit("")) == "")
    coy, years, onsite, overload, eeo, vague_hits = (F.col(c) for c in ("_coy", "_years", "_onsite", "_overload", "_eeo", "_vague_hits"))
    entry, junior = level == "entry", level.isin("entry", "associate")
    score = jobs.withColumns({
        "pay_penalty": F.when(no_pay, 25).otherwise(0) + F.when(wide, 10).otherwise(0) + F.when(coy, 10).otherwise(0) + F.when(no_period, 5).otherwise(0),
        "vague_penalty": F.least(vague_hits * 3, F.lit(15)),
        "scope_penalty": F.least(F.when(entry & (req >= 14), 25).when(entry & (req >= 10), 15).otherwise(0)
                                 + F.when(years, 10).otherwise(0) + F.when(overload, 10).otherwise(0), F.lit(25)),
        "consistency_penalty": F.least(F.when(entry & title.rlike(SENIOR_TITLE), 8).otherwise(0)
                                       + F.when((place == "remote") & onsite, 10).otherwise(0), F.lit(15)),
        "eeo_penalty": F.when(eeo, 3).otherwise(0),
        "salary_plausibility_penalty": F.when((level == "senior") & (high < 80_000), 15).when(junior & (low > 200_000), 10).otherwise(0),
        "title_inflation_penalty": F.when(junior & title.rlike(INFLATED_TITLE), 12).when((level == "mid") & title.rlike(EXECUTIVE_TITLE), 8).otherwise(0),
        "plausibility_penalty": F.coalesce("plausibility_penalty", F.lit(0)),
    })
    penalties = ["pay_penalty", "vague_penalty", "scope_penalty", "consistency_penalty", "eeo_penalty", "plausibility_penalty",
                 "salary_plausibility_penalty", "title_inflation_penalty"]
    total = sum((F.col(p) for p in penalties), F.lit(0))
    raised = F.array_compact(F.array(
        F.when(no_pay, F.lit("no_salary")), F.when(coy, F.lit("doe_competitive")), F.when(no_period, F.lit("salary_missing_period")),
        F.when(wide, F.lit("salary_too_wide")), F.when(entry & (req >= 10), F.lit("entry_heavy_requirements")),
        F.when(years, F.lit("years_requirement")), F.when(overload, F.lit("oncall_lean_fastpaced")),
        F.when(entry & title.rlike(SENIOR_TITLE), F.lit("entry_title_senior")),
        F.when((place == "remote") & onsite, F.lit("remote_but_onsite_language")), F.when(eeo, F.lit("eeo_dominates_posting")),
        F.when(F.col("plausibility_penalty") >= 10, F.lit("senior_stack_mismatch")),
        F.when(F.col("salary_plausibility_penalty") > 0, F.lit("salary_level_mismatch")),
        F.when(F.col("title_inflation_penalty") > 0, F.lit("title_inflation")),
    ))
    return score.select(
        "job_id", F.greatest(F.lit(100) - total, F.lit(0)).alias("honesty_score"), *penalties,
        F.concat(F.coalesce("plausibility_flags", F.array().cast("array<string>")), raised).alias("flags"))


def hiring_difficulty(jobs: DataFrame, companies: DataFrame, job_skills: DataFrame, skills: DataFrame, floor: int = 5) -> DataFrame:
    """Composite difficulty per company, scaled 0-100 over the data set."""
    tier1 = jobs.filter(F.col("data_tier") == 1).join(
        companies.filter(F.col("sector").isNotNull()).select("company_id", "company_name", "sector"), "company_id", "left")
    n_jobs = jobs.filter(F.col("data_tier") == 1).agg(F.count(F.lit(1)).alias("n"))
    tagged = job_skills.select("job_id", "skill_id", F.lower("skill_priority").alias("skill_priority"))
    in_tier1 = tagged.join(jobs.filter(F.col("data_tier") == 1).select("job_id"), "job_id", "left_semi")
    freq = in_tier1.groupBy("skill_id").agg((F.countDistinct("job_id") / n_jobs.scalar()).alias("pct"))
    relevant = skills.filter("difficulty_relevant").select("skill_id")
    # Both per-job facts come from one pass over the relevant skill rows.
    per_job = (
        tagged.join(relevant, "skill_id").join(freq, "skill_id", "left").groupBy("job_id")
        .agg(F.nullif(F.count_if(F.col("skill_priority") == "required"), F.lit(0)).alias("skill_count"),
             F.avg(F.when(F.col("pct") < NICHE_SHARE, 1.0).otherwise(0.0)).alias("niche_ratio"))
    )
    facts = tier1.select("job_id", "company_id", "company_name", "sector", "experience_level", "salary_max_annual").join(per_job, "job_id", "left")
    sectored = facts.filter(F.col("sector").isNotNull())
    bench = sectored.filter(F.col("experience_level").isNotNull()).groupBy("sector", F.col("experience_level").alias("primary_level")).agg(
        F.percentile(in_band(F.col("salary_max_annual")), 0.5).alias("median_max"), F.avg("skill_count").alias("avg_skills"))
    base = min_sample(sectored.groupBy("company_id", "company_name", "sector").agg(
        F.countDistinct("job_id").alias("total_roles"), F.mode("experience_level", True).alias("primary_level"),
        share(F.col("salary_max_annual").isNotNull()).alias("transparency_pct"),
        F.avg(in_band(F.col("salary_max_annual"))).alias("avg_max"), F.avg("skill_count").alias("avg_skill_count"),
        F.avg("niche_ratio").alias("niche")), floor, "total_roles")
    wide = base.join(bench, ["sector", "primary_level"], "left")
    opacity = F.lit(100.0) - F.col("transparency_pct")
    gap = (F.col("median_max") - F.col("avg_max")) / F.col("median_max") * 100
    parts = wide.withColumns({
        "opacity_score": rounded(opacity, 1),
        "salary_below_score": F.when(F.col("avg_max").isNotNull() & F.col("median_max").isNotNull(),
                                     F.when(gap <= 0, 0.0).otherwise(F.least(rounded(gap, 1), F.lit(100.0))))
        .otherwise(rounded(F.lit(10.0) + opacity * 0.5, 1)),
        "complexity_score": F.when((F.coalesce("avg_skills", F.lit(0.0)) == 0) | F.col("avg_skill_count").isNull(), 50.0)
        .otherwise(F.least(F.greatest(rounded(F.col("avg_skill_count") / F.col("avg_skills") * 50, 1), F.lit(0.0)), F.lit(100.0))),
        "rarity_score": rounded(F.col("niche") * 100, 1),
    })
    w = DIFFICULTY_WEIGHTS
    raw = parts.withColumn("raw_score", rounded(
        F.col("rarity_score") * w["rarity"] + F.col("complexity_score") * w["complexity"]
        + F.col("salary_below_score") * w["salary_below"] + F.col("opacity_score") * w["opacity"], 2))
    raw = cut_lineage(raw)  # one row a company, read for its range and again for the result
    span = raw.agg(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return raw.withColumns({"_lo": lo, "_hi": hi}).select(
        "company_id", "company_name", "sector", "total_roles", "primary_level",
        rounded((F.col("raw_score") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 100, 1).alias("difficulty_score"),
        "raw_score", "rarity_score", "complexity_score", "salary_below_score", "opacity_score",
        rounded(F.col("transparency_pct"), 0).alias("pct_transparent"), rounded(F.col("avg_max"), 0).alias("avg_max_salary"),
        rounded(F.col("median_max"), 0).alias("sector_median"))


def company_scorecard(dims: DataFrame, jobs: DataFrame, honesty: DataFrame, risk: DataFrame, difficulty: DataFrame,
                      job_skills: DataFrame, skills: DataFrame, floor: int = 3) -> DataFrame:
    """One row per company name with at least ``floor`` published roles."""
    public = jobs.filter((F.col("data_tier") == 1) & F.col("is_public"))
    facts = public.drop("honesty_score").join(honesty.select("job_id", "honesty_score"), "job_id", "left").join(
        risk.select("job_id", "ghost_probability", "ghost_tier"), "job_id", "left")
    active = facts.groupBy("company_id").agg(
        F.countDistinct("job_id").alias("active_roles"), rounded(F.avg(in_band(F.col("salary_max_annual"))), 0).alias("avg_max_salary"),
        share(F.col("salary_max_annual").isNotNull()).alias("transparency_pct"), rounded(F.avg("honesty_score"), 1).alias("avg_honesty_score"),
        F.mode("experience_level", True).alias("primary_level"), F.mode("workplace_type", True).alias("primary_workplace"),
        rounded(F.avg("ghost_probability"), 1).alias("avg_ghost_probability"),
        F.count_if(F.col("ghost_tier") == "high").alias("high_ghost_count"), F.count("ghost_tier").alias("scoreable_jobs"))
    counts = (
        job_skills.filter(F.lower("skill_priority") == "required").select("job_id", "skill_id")
        .join(skills.filter("difficulty_relevant").select("skill_id", "skill_name"), "skill_id")
        .join(public.select("job_id", "company_id"), "job_id").groupBy("company_id", "skill_name").agg(F.count(F.lit(1)).alias("n"))
    )
    # The list is bounded by the size of the skill taxonomy, not by postings.
    top = counts.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "skill_name"))).alias("_s")).select(
        "company_id", F.array_join(F.transform("_s", lambda s: s["skill_name"]), ", ").alias("top_skills"))
    hard = difficulty.select(F.lower("company_name").alias("_k"), "difficulty_score", "rarity_score", "complexity_score", "salary_below_score")
    hard = dedupe_best(hard, ["_k"], [F.col("difficulty_score").desc_nulls_last(), F.col("rarity_score").desc_nulls_last(),
                                      F.col("complexity_score").desc_nulls_last(), F.col("salary_below_score").desc_nulls_last()])
    wide = (
        dims.join(min_sample(active, floor, "active_roles").withColumnRenamed("active_roles", "published_roles"), "company_id")
        .join(top, "company_id", "left").withColumn("_k", F.lower("company_name")).join(hard, "_k", "left").drop("_k")
        .withColumn("ghost_rate_pct", rounded(F.col("high_ghost_count") * 100.0 / F.nullif(F.col("scoreable_jobs"), F.lit(0)), 1))
    )
    return dedupe_best(wide, ["company_name"], [F.col("published_roles").desc_nulls_last(), F.col("company_id")])


def repost_warning(df: DataFrame) -> DataFrame:
    n = F.coalesce("reappearance_count", F.lit(0))
    return df.withColumn("repost_warning", F.when(n > 0, F.struct(
        F.lit("Reposted").alias("label"), F.lit("Went away and came back with a newer date.").alias("message"), n.alias("count"))))
