"""Column-to-column helpers: staging, pay, dates, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Business constants of the pay model.
HOURS_PER_YEAR = 2080
MONTHS_PER_YEAR = 12
MIN_PLAUSIBLE_ANNUAL = 10_000
ANNUAL_BAND = (15_000, 1_000_000)
ENTERPRISE_ABOVE = 5_000
SECOND_TIER_SOURCE = "adzuna"

# Postal codes of US states and territories.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY "
    "NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI GU AS MP"
).split()

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def rounded(value: Column, digits: int) -> Column:
    """Half-away-from-zero rounding through DECIMAL, so engines agree on ties."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed != "", trimmed)


def unaccent(value: Column) -> Column:
    return F.translate(value, _ACCENTED, _PLAIN)


def share(condition: Column, digits: int = 1) -> Column:
    """Aggregate: percentage of rows for which ``condition`` holds."""
    return rounded(F.count_if(condition) * 100.0 / F.count(F.lit(1)), digits)


def stage_dim(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(c)) for c in cols})


def tier_or_default(tier: Column, source: Column) -> Column:
    return F.coalesce(tier, F.when(source == SECOND_TIER_SOURCE, 2).otherwise(1))


def _annual(amount: Column, period: Column, hourly: Column, hours: Column) -> Column:
    yearly = F.when(period == "month", amount * MONTHS_PER_YEAR).when(~hourly, amount)
    return F.when(hourly & ~F.coalesce(period == "month", F.lit(False)), amount * hours).otherwise(
        F.when(yearly >= MIN_PLAUSIBLE_ANNUAL, yearly)
    )


def canonicalize_pay(df: DataFrame) -> DataFrame:
    """Fill the annual pay columns from whatever pay fields a posting carries.

    Optional inputs (``pay_period``, ``is_hourly``, ``pay_min_raw``, ``pay_max_raw``,
    ``annualization_hours``) win over the legacy ``salary_*`` fields.  A monthly
    period is relabelled ``year`` while the raw amounts stay monthly.
    """

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    legacy_period = F.lower(blank_to_null(F.col("salary_period")))
    period = F.coalesce(F.lower(blank_to_null(given("pay_period", "string"))), legacy_period)
    staged = df.withColumns({
        "_period": period,
        "_min": F.coalesce(given("pay_min_raw", "double"), F.col("salary_min")).cast("double"),
        "_max": F.coalesce(given("pay_max_raw", "double"), F.col("salary_max")).cast("double"),
        "_hours": F.coalesce(given("annualization_hours", "int"), F.lit(HOURS_PER_YEAR)),
    }).withColumn(
        "_hourly",
        F.coalesce(given("is_hourly", "boolean"),
                   F.when(F.col("_period") == "hour", True).when(F.col("_period") == "year", False)),
    )
    p, h, n = F.col("_period"), F.col("_hourly"), F.col("_hours")
    return staged.withColumns({
        "pay_period": F.when(p == "month", "year").otherwise(p),
        "is_hourly": h,
        "pay_min_raw": F.col("_min"),
        "pay_max_raw": F.col("_max"),
        "annualization_hours": n,
        "salary_min_annual": _annual(F.col("_min"), p, h, n),
        "salary_max_annual": _annual(F.col("_max"), p, h, n),
    }).drop("_period", "_min", "_max", "_hours", "_hourly")


def annualize(amount: Column, period: Column) -> Column:
    """Annual pay, or null when the period is unknown or the result implausible."""
    factor = F.when(period == "year", 1).when(period == "month", MONTHS_PER_YEAR).when(period == "hour", HOURS_PER_YEAR)
    annual = amount * factor
    return F.when(annual.between(*ANNUAL_BAND), annual)


def salary_midpoint(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


def days_open(df: DataFrame, as_of: str) -> DataFrame:
    today = F.lit(as_of).cast("date")
    return df.withColumns({
        "days_open": F.when(F.col("status") == "raw", F.datediff(today, "posted_date"))
        .when(F.col("status") == "expired", F.datediff(F.col("last_seen_at").cast("date"), "posted_date")),
        "days_tracked": F.datediff(F.col("last_seen_at").cast("date"), F.col("ingested_at").cast("date")),
    })


# Neutral default role families: (label, phrases); the first family with a hit wins.
ROLE_FAMILIES = [("Engineering", r"\bengineer"), ("Science", r"\bscientist\b"), ("Analysis", r"\banalyst\b"), ("Management", r"\bmanager\b")]


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first rule whose pattern is found in ``value``."""
    out = None
    for label, pattern in rules:
        out = (F if out is None else out).when(value.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def role_family(title: Column, rules: list[tuple[str, str]] = ROLE_FAMILIES) -> Column:
    return first_match(F.lower(title), rules, "Other")


def md5_id(prefix: str, *cols: Column, n: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *cols)), 1, n))


def slug(value: Column, width: int = 80) -> Column:
    text = F.replace(F.lower(unaccent(value)), F.lit("&"), F.lit(" and "))
    dashed = F.regexp_replace(text, "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, width)


# Default employment aliases, already normalised to lower case with spaces.
EMPLOYMENT_ALIASES = {
    "full time": "full-time", "fulltime": "full-time", "permanent": "full-time", "regular": "full-time",
    "part time": "part-time", "parttime": "part-time", "intern": "internship", "internship": "internship",
    "contract": "contract", "contractor": "contract", "freelance": "contract",
    "temporary": "temporary", "temp": "temporary", "seasonal": "temporary",
}


def normalize_employment_type(value: Column, aliases: dict[str, str] = EMPLOYMENT_ALIASES) -> Column:
    key = F.trim(F.regexp_replace(F.lower(value), "[^a-z]+", " "))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.element_at(table, key)


POSTED_FORMATS = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy")


def parse_posted_date(value: Column) -> Column:
    """A date in one of the known forms (or epoch seconds / milliseconds), else null."""
    text = F.trim(value)
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1), POSTED_FORMATS[0])
    epoch = F.when(text.rlike(r"^\d{10}$"), text.cast("bigint")).when(
        text.rlike(r"^\d{13}$"), (text.cast("bigint") / 1000).cast("bigint"))
    parsed = [F.try_to_timestamp(text, F.lit(fmt)).cast("date") for fmt in POSTED_FORMATS[1:]]
    return F.coalesce(iso, F.timestamp_seconds(epoch).cast("date"), *parsed)


def parse_relative_date(value: Column, as_of: str) -> Column:
    """'3 days ago', '2 weeks ago', 'yesterday', 'today' relative to ``as_of``."""
    text = F.lower(F.trim(value))
    amount = F.regexp_extract(text, r"^(\d+)\+? (?:hour|day|week|month)s? ago$", 1)
    unit = F.regexp_extract(text, r"^\d+\+? (hour|day|week|month)s? ago$", 1)
    days = (
        F.when(text == "today", 0).when(text == "yesterday", 1)
        .when(unit == "hour", 0).when(unit == "day", amount.try_cast("int"))
        .when(unit == "week", amount.try_cast("int") * 7).when(unit == "month", amount.try_cast("int") * 30)
    )
    return F.date_sub(F.lit(as_of).cast("date"), days)


def parse_remote_type(value: Column) -> Column:
    """Workplace label used by sources that send free text."""
    text = F.lower(value)
    return (
        F.when(text.contains("hybrid"), "hybrid").when(text.contains("remote"), "remote")
        .when(text.contains("site") | text.contains("office"), "onsite")
    )


def trusted_us_location(country: Column, state: Column, source: Column, workplace: Column,
                        trusted_sources: tuple[str, ...] = ("greenhouse", "lever", "ashby"),
                        remote_sources: tuple[str, ...] = ("workday",)) -> Column:
    """US evidence for the public feed; unknown countries pass for trusted sources only."""
    in_us = F.upper(F.coalesce(state, F.lit(""))).isin(US_STATES)
    return (
        (country.isin("US", "United States", "USA") & (state.isNull() | in_us))
        | (country.isNull() & in_us)
        | ((country == "unknown") & F.lower(F.coalesce(source, F.lit(""))).isin(*trusted_sources))
        | ((country == "unknown") & F.lower(F.coalesce(source, F.lit(""))).isin(*remote_sources)
           & (F.lower(F.coalesce(workplace, F.lit(""))) == "remote"))
    )
