"""Pay extraction from posting text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window around a money sign, sanity bands per period.
BEFORE, AFTER, MAX_WINDOWS = 350, 700, 20
BANDS = {"year": (15_000, 1_000_000), "month": (1_000, 50_000), "hour": (7, 500)}
PAY_WORDS = r"(?i)salary|compensation|pay\s+(?:range|rate|band)|base\s+pay|hourly\s+rate|wage|hiring\s+range"

_NUM = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d{1,3}(?:\.\d{3})+,\d{2}|\d+(?:\.\d+)?)"
_DASH = r"\s*(?:-|–|—|~|to|and|/)\s*"
_MONEY = rf"(?:(?:usd|cad|us)\s*)?\$\s*{_NUM}\s*(k|m)?"
_AFTER = r"(?:\s*(?:usd|cad|ote|per (?:hour|year)|/\s?(?:hr|yr|hour|year)))?"
# Ordered by how much the text commits to; groups are (low, K, high, K).
RANGE_PATTERNS = [
    rf"(?i){_MONEY}\s*\(min\w*\).{{0,60}}{_MONEY}\s*\(max\w*\)",
    rf"(?i)min(?:imum)?[^$\d]{{0,25}}{_MONEY}\b.{{0,40}}max(?:imum)?[^$\d]{{0,25}}{_MONEY}\b",
    rf"(?i)(?:begin|start)\w*\s+at\s+{_MONEY}\b.{{0,20}}\bup to\s+{_MONEY}\b",
    rf"(?i){_MONEY}{_AFTER}{_DASH}(?:(?:usd|cad)\s*)?\$?\s*{_NUM}\s*(k|m)?\b",
    rf"(?i)\b{_NUM}\s*(k)?{_DASH}{_NUM}\s*(k)?\s*(?:usd|dollars)\b",
    rf"(?i)\b(?:ote|on-target earnings)\b[^$]{{0,30}}{_MONEY}\b[^$]{{0,80}}\bbase\b[^$]{{0,30}}{_MONEY}\b",
]
SINGLE_PATTERNS = [
    rf"(?i)(?:salar\w*|pay|rate|compensation|wage)[^$]{{0,40}}{_MONEY}(?:\b|\+)",
    rf"(?i){_MONEY}\s*(?:per|an?|/)\s*(?:hour|hr|month|mo|year|yr|annum)",
    rf"(?i){_MONEY}\s*\+?\s*(?:annual|yearly|base)\b",
]
NOT_PAY = r"(?i)401\(?k|funding|raised|revenue|valuation|stipend|reimburse|budget|assets|referral|\barr\b|bonus(?:es)?\s+(?:range|of|up)|equity\s+(?:grant|value|award)"
# Amounts like "$140 - $150 USD a year" leave out the thousands: whole numbers in this band, with these words near.
SHORT_BAND, SHORT_WORDS = (60, 999), r"(?i)annual|per year|/\s?y(?:ea)?r|\busd\b"
PERIOD_WORDS = [("hour", r"(?i)per hour|hourly|/\s?h(?:ou)?r|an hour"), ("month", r"(?i)per month|monthly|/\s?mo\b|a month"),
                ("year", r"(?i)per year|per annum|annual|yearly|/\s?y(?:ea)?r|a year")]


def salary_windows(text: Column) -> Column:
    """Context around each money sign that also talks about pay, at most twenty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\$")
    state = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")),
        lambda acc, part: F.struct((acc["at"] + F.length(part) + 1).alias("at"), F.array_append(acc["hits"], acc["at"] + F.length(part) + 1).alias("hits")))
    hits = F.slice(state["hits"], 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    cut = F.transform(hits, lambda p: F.substring(text, F.greatest(p - BEFORE, F.lit(1)), F.lit(AFTER) + p - F.greatest(p - BEFORE, F.lit(1))))
    return F.array_join(F.slice(F.filter(cut, lambda w: w.rlike(PAY_WORDS)), 1, MAX_WINDOWS), "\n")


def _number(raw: Column, unit: Column) -> Column:
    european = raw.rlike(r"^\d{1,3}(\.\d{3})+,\d{2}$")
    plain = F.when(european, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    # "161,000K" says the thousands twice.
    return value * F.when(value >= 1_000, 1).when(F.lower(unit) == "k", 1_000).when(F.lower(unit) == "m", 1_000_000).otherwise(1)


def _period(line: Column, high: Column) -> Column:
    out = None
    for name, pattern in PERIOD_WORDS:
        out = (F if out is None else out).when(line.rlike(pattern), F.lit(name))
    return out.when(high >= 15_000, "year").when(high >= 1_000, "month").otherwise("hour")


def _captures(line: Column, pattern: str, single: bool) -> Column:
    """Raw pieces of one pattern on one line, or null."""
    piece = lambda i: F.regexp_extract(line, pattern, i)
    low, unit = piece(1), piece(2)
    high, high_unit = (low, unit) if single else (piece(3), piece(4))
    return F.when(line.rlike(pattern), F.struct(line.alias("line"), low.alias("low"), unit.alias("unit"), high.alias("high"), high_unit.alias("high_unit")))


def extract_salary(text: Column) -> Column:
    """First sane pay statement, by line or sentence and then by pattern priority.

    Each stage is a transform over the results of the one before: a lambda is not
    scanned for common parts, so nothing costly may be written twice inside one.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[a-z)][.!?])\s+(?=\p{Lu})"), lambda line: line.rlike(r"(?i)\$|\busd\b|dollars") & (~line.rlike(NOT_PAY) | line.rlike(PAY_WORDS)))
    raw = F.flatten(F.transform(lines, lambda line: F.array_compact(F.array(
        *[_captures(line, p, False) for p in RANGE_PATTERNS], *[_captures(line, p, True) for p in SINGLE_PATTERNS]))))
    # "$140-160K": the unit written once belongs to both ends.
    valued = F.transform(raw, lambda c: F.struct(c["line"].alias("line"), _number(c["low"], c["unit"]).alias("a"), _number(c["high"], c["high_unit"]).alias("b"),
                                                 F.when((c["unit"] == "") & (c["high_unit"] != ""), _number(c["low"], c["high_unit"])).alias("shared")))
    ends = F.transform(valued, lambda c: F.struct(c["line"].alias("line"), F.when(c["shared"].isNotNull() & (c["a"] < 1_000), c["shared"]).otherwise(c["a"]).alias("a"), c["b"].alias("b")))
    low, high = SHORT_BAND
    short = F.transform(ends, lambda c: F.struct(c["line"].alias("line"), c["a"].alias("a"), c["b"].alias("b"), F.when(
        c["a"].between(low, high) & c["b"].between(low, high) & (c["a"] == F.floor(c["a"])) & (c["b"] == F.floor(c["b"])) & c["line"].rlike(SHORT_WORDS) & ~c["line"].rlike(PERIOD_WORDS[0][1]), 1_000).otherwise(1).alias("x")))
    whole = F.transform(short, lambda c: F.struct(c["line"].alias("line"), (c["a"] * c["x"]).alias("a"), (c["b"] * c["x"]).alias("b")))
    dated = F.transform(whole, lambda c: F.struct(F.least(c["a"], c["b"]).alias("lo"), F.greatest(c["a"], c["b"]).alias("hi"), _period(c["line"], F.greatest(c["a"], c["b"])).alias("period")))

    def sane(c: Column) -> Column:
        ok = F.lit(False)
        for name, (least, most) in BANDS.items():
            ok = ok | ((c["period"] == name) & (c["lo"] >= least) & (c["hi"] <= most))
        return ok

    return F.get(F.filter(dated, sane), F.lit(0))


def merge_salary(df: DataFrame, parsed: str, repair: bool = False) -> DataFrame:
    """Structured pay wins; ``repair`` lets the parsed values overwrite."""
    p = F.col(parsed)
    pairs = {"salary_min": p["lo"], "salary_max": p["hi"], "salary_period": p["period"]}
    return df.withColumns({c: F.coalesce(v, F.col(c)) if repair else F.coalesce(F.col(c), v) for c, v in pairs.items()})
