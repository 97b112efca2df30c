"""Company history, the daily radar, alerts and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rounded, trusted_us_location
from ..operators.filters import EXCLUSIONS, ROLE_LIKE_NAME, apply_exclusions
from ..operators.relational import dedupe_best, top_per_group, with_group_facts
from ..session import cut_lineage

# Fixed values of the radar: look-back windows in days and alert thresholds.
NEW_DAYS, REPOST_DAYS, CLOSED_DAYS = 7, 30, 90
LIFETIME_BAND = (2, 365)
MIN_CLOSED = 5
TOP_ROLES = 5
SURGE = {"coverage_days": 14, "prior": 3, "gain": 3, "ratio": 1.25}
FRESH = {"coverage_days": 7, "new": 5}
REPOST_ALERT = 2
HISTORY_DAYS = (31, 120)


def company_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def preferred_name(df: DataFrame, key: str, name: str) -> DataFrame:
    """Most frequent spelling per key, then the longest."""
    counts = df.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    return dedupe_best(counts, [key], [F.col("n").desc(), F.length(name).desc(), F.col(name)]).drop("n")


def company_history(postings: DataFrame, companies: DataFrame, reposts: DataFrame) -> DataFrame:
    named = companies.filter(~F.col("company_name").rlike(ROLE_LIKE_NAME)).select("company_id", "company_name", company_key(F.col("company_name")).alias("company_key"))
    jobs = postings.filter(F.col("data_tier") == 1).join(named, "company_id")
    public = (F.col("status") == "raw") & F.col("is_public")
    opp = F.coalesce("canonical_opportunity_id", "job_id")
    lifetime = F.datediff("last_seen_at", "date_found")
    base = jobs.groupBy("company_key").agg(
        F.min("date_found").alias("coverage_started_at"), F.max("last_seen_at").alias("last_observed_at"),
        F.count(F.lit(1)).alias("source_postings"), F.countDistinct(opp).alias("observed_opportunities"),
        F.count_if(public).alias("active_source_postings"), F.countDistinct(F.when(public, opp)).alias("active_opportunities"),
        F.count_if(F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()).alias("salary_disclosed"),
        rounded(F.percentile(F.when((F.col("status") == "expired") & (lifetime >= LIFETIME_BAND[0]), lifetime), 0.5), 1).alias("median_observed_lifetime_days"))
    all_names = companies.select("company_id", company_key(F.col("company_name")).alias("company_key"))
    bulk = F.col("signal_class") == "bulk_ats_date_refresh"
    signals = reposts.join(all_names, "company_id").groupBy("company_key").agg(
        F.count_if(F.col("signal_class") == "individual_repost_signal").alias("individual_repost_signals"),
        F.count_if(bulk).alias("bulk_ats_refresh_events"), F.countDistinct(F.when(bulk, F.col("observed_on"))).alias("bulk_refresh_days"))
    return (
        base.join(preferred_name(jobs.select("company_key", "company_name"), "company_key", "company_name"), "company_key")
        .join(signals, "company_key", "left").na.fill(0, ["individual_repost_signals", "bulk_ats_refresh_events", "bulk_refresh_days"])
        .withColumn("salary_transparency_pct", rounded(F.col("salary_disclosed") * 100.0 / F.col("source_postings"), 1))
    )


def company_daily_snapshot(history: DataFrame, day: str) -> DataFrame:
    return history.select(
        F.lit(day).cast("date").alias("snapshot_date"), "company_key", "company_name", "active_source_postings", "active_opportunities",
        "observed_opportunities", "salary_transparency_pct", "individual_repost_signals", "bulk_ats_refresh_events")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans (lo, hi) of each key merged where they meet: disjoint ones that cover the same days.

    Equal spans are folded first, so a key has no more of them than there are pairs of days.
    """
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") > F.date_add(reach, 1)), 1).otherwise(0)
    numbered = spans.select(*keys, "lo", "hi").distinct().withColumn("_o", opens).withColumn("_i", F.sum("_o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_i")


def edges(spans: DataFrame, keys: list[str], values: dict[str, Column], names: list[str]) -> DataFrame:
    """What changes on which day: each span adds its values on its first day and takes them off after its last."""
    known = [values.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]
    each = spans.filter("lo <= hi").select(*keys, "lo", "hi", *known).groupBy(*keys, "lo", "hi").agg(*[F.sum(n).alias(n) for n in names])
    ends = F.explode(F.array(F.struct(F.col("lo").alias("day"), F.lit(1).alias("sign")), F.struct(F.date_add("hi", 1).alias("day"), F.lit(-1).alias("sign"))))
    return each.withColumn("_e", ends).select(*keys, "_e.day", *[(F.col(n) * F.col("_e.sign")).alias(n) for n in names])


def sweep(changes: DataFrame, keys: list[str], names: list[str], last: Column, day: str = "snapshot_date", among: str | None = None) -> DataFrame:
    """Running sums of the changes of each key on every day from its first change to ``last`` on which one, or ``among``, is not zero."""
    order = Window.partitionBy(*keys).orderBy("day")
    steps = changes.groupBy(*keys, "day").agg(*[F.sum(n).alias(n) for n in names])
    sums = steps.select(*keys, "day", F.lead("day").over(order).alias("_next"), *[F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names])
    end = F.least(F.date_sub("_next", 1), last)
    known = [among] if among else names
    some = sums.filter(F.greatest(*[F.col(n) for n in known]) > 0 if len(known) > 1 else F.col(known[0]) > 0).filter(F.col("day") <= end)
    return some.select(*keys, F.explode(F.sequence("day", end)).alias(day), *names)


def radar_snapshot(postings: DataFrame, companies: DataFrame, reposts: DataFrame, first_day: str, last_day: str, as_of: str, exclusions: list[tuple[str, str]] = EXCLUSIONS) -> DataFrame:
    """Company radar for a whole range of days in one job.

    Days before ``as_of`` are rebuilt from first/last observed dates; ``as_of``
    itself uses the published flag.  A posting is never copied to the days it is open on: the
    spans of an opportunity are merged, their ends are counted by day, and running sums give
    each day's numbers.  Closures fan out as counts per (last day, lifetime).
    """
    d0, d1, today = (F.lit(d).cast("date") for d in (first_day, last_day, as_of))

    def span(start: Column, end: Column) -> Column:
        """The days of the range from start to end; null if there are none."""
        lo, hi = F.greatest(start, d0), F.least(end, d1)
        return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi")))

    def days_between(start: Column, end: Column) -> Column:
        lo, hi = F.greatest(start, d0), F.least(end, d1)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>"))

    allowed = apply_exclusions(companies, "company_name", [(text, "substring") for text, _ in exclusions]).select("company_id")
    start = F.coalesce("posted_date", "date_found")
    rows = postings.filter(
        (F.col("data_tier") == 1) & F.col("domain").isNotNull() & (F.coalesce("status", F.lit("")) != "ignored")
        & (F.col("loc_country").isNull() | (F.col("loc_country") != "foreign"))
        & trusted_us_location(F.col("loc_country"), F.col("loc_state"), F.col("ingestion_source"), F.col("workplace_type"))
    ).join(allowed, "company_id", "left_semi").select(
        "job_id", "company_id", "domain", "status", "is_public", F.nullif(F.trim("role_category"), F.lit("")).alias("role_category"),
        F.coalesce("canonical_opportunity_id", "job_id").alias("opp"), F.coalesce("date_found", "posted_date").alias("first_day"),
        F.col("last_seen_at").cast("date").alias("last_day"),
        (F.col("salary_min_annual").isNotNull() | F.col("salary_max_annual").isNotNull()).alias("priced"),
        F.when(F.col("last_seen_at").cast("date") >= start, F.datediff(F.col("last_seen_at").cast("date"), start)).alias("lifetime"))
    eligible = with_group_facts(rows, ["company_id", "opp"], opp_first=F.min("first_day"), opp_last=F.max("last_day"), opp_public=F.bool_or("is_public"))
    scoped = cut_lineage(eligible.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("domain")))))
    who = ["company_id", "scope"]
    keys = ["snapshot_date", *who]

    past = span(F.col("first_day"), F.least(F.coalesce("last_day", d1), F.date_sub(today, 1)))
    live = F.when(F.col("is_public"), span(today, d1))
    spans = scoped.withColumn("_s", F.explode(F.array_compact(F.array(past, live)))).select("*", "_s.lo", "_s.hi")
    open_opps = islands(spans, [*who, "opp", "opp_first"])
    fresh = open_opps.withColumns({"lo": F.greatest("lo", "opp_first"), "hi": F.least("hi", F.date_add("opp_first", NEW_DAYS - 1))}).filter("opp_first IS NOT NULL")
    gone_until = F.when(F.col("opp_public"), F.least(F.date_add("opp_last", NEW_DAYS - 1), F.date_sub(today, 1))).otherwise(F.date_add("opp_last", NEW_DAYS - 1))
    gone = scoped.select(*who, "opp", "opp_last", "opp_public").distinct().filter("opp_last IS NOT NULL").withColumn("_s", span(F.col("opp_last"), gone_until)).filter("_s IS NOT NULL").select("*", "_s.lo", "_s.hi")
    back = scoped.select("job_id", *who).join(reposts.select("job_id", "event_id", "observed_on", "signal_class"), "job_id").select(*who, "event_id", "observed_on", "signal_class").distinct()
    back = back.withColumn("_s", span(F.col("observed_on"), F.date_add("observed_on", REPOST_DAYS - 1))).filter("_s IS NOT NULL").select("*", "_s.lo", "_s.hi")

    # A company has a row on every day from the first on which anything was found, so its coverage goes through the same sums.
    since = scoped.groupBy(*who).agg(F.min("first_day").alias("_since")).filter("_since IS NOT NULL")
    covered = since.withColumn("_s", span(F.col("_since"), d1)).filter("_s IS NOT NULL").select("*", "_s.lo", "_s.hi")

    names = ["active_opportunities", "active_source_postings", "_priced", "new_opportunities_7d", "disappeared_opportunities_7d", "individual_repost_signals_30d", "bulk_refresh_events_30d", "_covered", "_since"]
    one = F.lit(1)
    changes = [
        edges(spans, who, {"active_source_postings": one, "_priced": F.col("priced").cast("int")}, names),
        edges(open_opps, who, {"active_opportunities": one}, names),
        edges(fresh, who, {"new_opportunities_7d": one}, names),
        edges(gone, who, {"disappeared_opportunities_7d": one}, names),
        edges(back, who, {"individual_repost_signals_30d": (F.col("signal_class") == "individual_repost_signal").cast("int"), "bulk_refresh_events_30d": (F.col("signal_class") == "bulk_ats_date_refresh").cast("int")}, names),
        edges(covered, who, {"_covered": one, "_since": F.unix_date("_since")}, names),
    ]
    metrics = sweep(reduce(DataFrame.unionByName, changes), who, names, d1, among="_covered").withColumn("coverage_started_at", F.date_from_unix_date(F.col("_since").cast("int")))
    metrics = metrics.withColumn("salary_transparency_pct", rounded(F.col("_priced") * 100.0 / F.nullif("active_source_postings", F.lit(0)), 1)).drop("_priced", "_covered", "_since")

    role_keys = [*who, "role_category"]
    open_roles = islands(spans.filter(F.col("role_category").isNotNull()), [*role_keys, "opp"])
    roles = sweep(edges(open_roles, role_keys, {"n": one}, ["n"]), role_keys, ["n"], d1)
    mix = top_per_group(roles, keys, [F.col("n").desc(), F.col("role_category")], TOP_ROLES, rank_as="place").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("place", "role_category", "n"))).alias("_m")).withColumn(
        "role_mix", F.transform("_m", lambda m: F.struct(m["role_category"].alias("role"), m["n"].alias("count")))).drop("_m")

    closed = scoped.filter((F.col("status") == "expired") & F.col("lifetime").between(*LIFETIME_BAND)).groupBy("company_id", "scope", "last_day", "lifetime").agg(F.count(F.lit(1)).alias("n"))
    closed = closed.withColumn("snapshot_date", F.explode(days_between(F.col("last_day"), F.date_add("last_day", CLOSED_DAYS - 1)))).groupBy(*keys).agg(
        rounded(F.percentile("lifetime", 0.5, F.col("n")), 1).alias("median_closed_lifetime_days"), F.sum("n").alias("_n")).filter(F.col("_n") >= MIN_CLOSED).drop("_n")

    out = metrics.join(closed, keys, "left").join(mix, keys, "left")
    return out.withColumn(
        "snapshot_source", F.when(F.col("snapshot_date") < today, "archive_reconstruction").otherwise("live"))


def history_range(observed_days: DataFrame, as_of: str, wanted: int = 45) -> DataFrame:
    """One row: the first day to (re)build — a long range until enough days exist."""
    days = max(HISTORY_DAYS[0], min(wanted, HISTORY_DAYS[1]))
    today = F.lit(as_of).cast("date")
    return observed_days.agg(F.countDistinct("snapshot_date").alias("n")).select(
        F.when(F.col("n") < HISTORY_DAYS[0], F.date_sub(today, days - 1)).otherwise(today).alias("first_day"), today.alias("last_day"))


def radar_alerts(radar: DataFrame, follows: DataFrame, day: str, existing: DataFrame | None = None) -> DataFrame:
    """Surge, fresh-role and repost alerts for followers, each at most once."""
    today = F.lit(day).cast("date")
    overall = radar.filter(F.col("scope") == "all")
    now = overall.filter(F.col("snapshot_date") == today)
    before = overall.filter(F.col("snapshot_date") == F.date_sub(today, 7)).select("company_id", F.col("active_opportunities").alias("prior"))
    active, prior, seen = F.col("active_opportunities"), F.col("prior"), F.datediff(today, "coverage_started_at")

    def alert(kind: str, when: Column, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("alert_type"), a.cast("bigint").alias("value"), b.cast("bigint").alias("reference")))

    raised = F.array_compact(F.array(
        alert("hiring_surge", (seen >= SURGE["coverage_days"]) & (prior >= SURGE["prior"]) & (active - prior >= SURGE["gain"])
              & (active >= F.ceil(prior * SURGE["ratio"])), active, prior),
        alert("fresh_roles", (seen >= FRESH["coverage_days"]) & (F.col("new_opportunities_7d") >= FRESH["new"]), F.col("new_opportunities_7d"), active),
        alert("repost_watch", F.col("individual_repost_signals_30d") >= REPOST_ALERT, F.col("individual_repost_signals_30d"), F.lit(None)),
    ))
    wanted = follows.filter(F.col("alert_frequency") != "none").select("user_id", "company_id")
    # One row per company and alert first; followers multiply only real alerts.
    alerts = now.join(before, "company_id", "left").select("company_id", "scope", F.explode(raised).alias("_a")).select(
        "company_id", "scope", today.alias("signal_date"), "_a.*").join(wanted, "company_id")
    if existing is not None:
        alerts = alerts.join(existing, ["user_id", "company_id", "scope", "alert_type", "signal_date"], "left_anti")
    return alerts


def digest_batches(alerts: DataFrame, users: DataFrame, follows: DataFrame, delivered_ids: DataFrame, sent_today: DataFrame,
                   cadence: str, day: str, newest: int = 20) -> DataFrame:
    """Undelivered alerts per opted-in user, newest ``newest`` ids."""
    lookback = 1 if cadence == "daily" else 7
    fresh = alerts.filter(F.col("signal_date") >= F.date_sub(F.lit(day).cast("date"), lookback))
    opted = users.filter(F.col("active") & F.col("email").isNotNull() & F.coalesce("email_enabled", F.lit(True)) & (F.coalesce("frequency", F.lit("weekly")) == cadence))
    due = (
        fresh.join(follows.filter(F.col("alert_frequency") == cadence).select("user_id", "company_id"), ["user_id", "company_id"], "left_semi")
        .join(opted.select("user_id", "email"), "user_id").join(delivered_ids, "alert_id", "left_anti").join(sent_today, "user_id", "left_anti")
    )
    # Keep the newest first, then collect: the list never exceeds ``newest`` ids.
    top = top_per_group(due, ["user_id"], [F.col("signal_date").desc(), F.col("alert_id").desc()], newest, rank_as="place")
    return top.groupBy("user_id", "email").agg(F.max("signal_date").alias("newest_signal"), F.array_sort(F.collect_list(F.struct("place", "alert_id"))).alias("_l")).select(
        "user_id", "email", "newest_signal", F.transform("_l", lambda x: x["alert_id"]).alias("alert_ids"))


def research_queue(radar: DataFrame, companies: DataFrame, follows: DataFrame, state: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Followed companies first, then momentum; a company rests seven days after an attempt."""
    overall = radar.filter(F.col("scope") == "all")
    latest = overall.filter(F.col("snapshot_date") == overall.agg(F.max("snapshot_date").alias("d")).scalar())
    followers = follows.groupBy("company_id").agg(F.countDistinct("user_id").alias("n"))
    rested = F.col("last_attempted_on").isNull() | (F.col("last_attempted_on") < F.date_sub(F.lit(as_of).cast("date"), 7))
    queue = (
        latest.select("company_id", "active_opportunities", "new_opportunities_7d").join(companies.filter(F.col("company_name").isNotNull()).select("company_id", "company_name"), "company_id")
        .join(followers, "company_id", "left").join(state, "company_id", "left").filter(rested)
        .withColumn("follower_count", F.coalesce("n", F.lit(0))).drop("n")
    )
    return queue.orderBy(F.col("follower_count").desc(), F.col("new_opportunities_7d").desc(), F.col("active_opportunities").desc(), "company_id").limit(limit)
