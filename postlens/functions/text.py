"""Text helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import blank_to_null, first_match, unaccent

# Character references decoded when stripping markup.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def decode_entities(value: Column) -> Column:
    for ref, char in ENTITIES:
        value = F.replace(value, F.lit(ref), F.lit(char))
    return value


def strip_html(value: Column) -> Column:
    """Visible text: line breaks for <br> and <li>, tags dropped, entities decoded."""
    text = F.regexp_replace(value, r"(?i)<(?:br|/p|/div|/h[1-6]|li)[^>]*>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def normalized(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def parse_workplace(value: Column) -> Column:
    return first_match(normalized(value), [("hybrid", r"\bhybrid\b"), ("remote", r"\bremote\b"), ("onsite", r"\bon[- ]?site\b|\bin office\b")])


def parse_employment(value: Column) -> Column:
    return first_match(normalized(value), [
        ("full-time", r"\bfull[- ]?time\b"), ("part-time", r"\bpart[- ]?time\b"), ("internship", r"\bintern(ship)?\b"),
        ("contract", r"\bcontract(or)?\b"), ("temporary", r"\btemp(orary)?\b")])


# Neutral keyword rules, most specific first: defaults of arguments.  The labels are fixed values.
ARCHETYPES = [
    ("data_engineer", r"\b(data|pipeline|warehouse) engineer"),
    ("data_scientist", r"\bscientist\b"),
    ("product_analyst", r"\bproduct analy"),
    ("marketing_analyst", r"\bmarketing analy"),
    ("financial_analyst", r"\b(finance|financial) analy"),
    ("revenue_analyst", r"\b(revenue|sales) analy"),
    ("analyst", r"\banalyst\b"),
    ("consultant", r"\bconsultant\b"),
]
COMPANY_TYPES = [
    ("staffing", r"\b(staffing|temp) agency\b"),
    ("consulting", r"\b(consultancy|advisory firm)\b"),
    ("nonprofit", r"\b(charity|foundation|not-for-profit)\b"),
    ("government", r"\b(ministry|city council|federal agency|public sector)\b"),
    ("education", r"\b(university|college|school)\b"),
    ("healthcare", r"\b(hospital|clinic)\b"),
    ("public", r"\b(publicly traded|listed on|stock exchange)\b"),
    ("private", r"\b(privately held|family-owned)\b"),
]


def archetype(title: Column, rules: list[tuple[str, str]] = ARCHETYPES) -> Column:
    return first_match(normalized(title), rules)


def company_type(text: Column, rules: list[tuple[str, str]] = COMPANY_TYPES) -> Column:
    return first_match(normalized(text), rules)


def dedup_normalize(value: Column) -> Column:
    """Text without what trackers vary: tags, entities, links, digits, punctuation."""
    text = F.lower(decode_entities(F.regexp_replace(F.coalesce(value, F.lit("")), r"<[^>]+>", " ")))
    text = F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}]+", " "))


def words(value: Column) -> Column:
    """Lower-case tokens; ``+``, ``#`` and inner dots survive (c++, c#, node.js)."""
    return F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}0-9+#]+(?:\.[\p{L}0-9+#]+)*"), F.lit(0))


def ngrams(tokens: Column, upto: int) -> Column:
    """All runs of 1..``upto`` tokens, as strings (the last runs repeat shorter ones)."""
    grams = runs = tokens
    for n in range(2, upto + 1):
        following = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens), F.lit(0)))
        runs = F.zip_with(runs, following, lambda a, b: F.concat_ws(" ", a, b))
        grams = F.concat(grams, runs)
    return grams


def token_rows(df: DataFrame, keep: list[str], text: Column, ahead: int) -> DataFrame:
    """One row per token with the tokens that follow it: w1, w2, ... ``w{ahead}``.

    Zipping shifted copies is cheaper than building n-gram strings, and the rows
    are joined where they are made.
    """
    names = [f"w{n}" for n in range(1, ahead + 1)]
    toks = df.select(*keep, words(text).alias("w1"))
    shifted = toks.withColumns({f"w{n}": F.slice("w1", F.lit(n), F.size("w1")) for n in range(2, ahead + 1)})
    return shifted.select(*keep, F.inline(F.arrays_zip(*names)))


# Words that carry no identity in an employer's name.
LEGAL_WORDS = ["inc", "llc", "ltd", "corp", "corporation", "company", "co", "the", "group", "holdings", "gmbh", "plc", "and"]


def name_tokens(value: Column) -> Column:
    raw = F.filter(F.split(F.lower(unaccent(value)), "[^a-z0-9]+"), lambda w: w != "")
    core = F.array_except(raw, F.array(*[F.lit(w) for w in LEGAL_WORDS]))
    return F.when(F.size(core) > 0, core).otherwise(F.array_distinct(raw))


def company_key(value: Column) -> Column:
    return F.array_join(name_tokens(value), "-")


def org_match(a: Column, b: Column, threshold: float = 0.6) -> Column:
    """Whether two employer names share enough of the shorter name's tokens."""
    x, y = name_tokens(a), name_tokens(b)
    shorter = F.least(F.size(x), F.size(y))
    return (shorter > 0) & (F.size(F.array_intersect(x, y)) / shorter >= threshold)


# Per source: where the tenant sits in a posting's address.
TENANT_PATTERNS = {
    "greenhouse": r"greenhouse\.io/(?:embed/job_app\?for=)?([a-z0-9_-]+)", "lever": r"lever\.co/([a-z0-9_.-]+)", "ashby": r"ashbyhq\.com/([a-z0-9_.%-]+)",
    "workday": r"https?://([a-z0-9_-]+)\.wd\d+\.myworkdayjobs\.com",
}


def infer_tenant(source: Column, source_id: Column, url: Column, patterns: dict[str, str] = TENANT_PATTERNS) -> Column:
    out = None
    for name, pattern in patterns.items():
        out = (F if out is None else out).when(source == name, F.regexp_extract(F.lower(url), pattern, 1))
    from_url = blank_to_null(out.otherwise(F.lit("")))
    return F.coalesce(from_url, F.when(source_id.contains("|"), F.split_part(source_id, F.lit("|"), F.lit(1))))


def plausible_name(name: Column) -> Column:
    text = F.trim(name)
    return text.isNotNull() & (F.length(text) >= 2) & ~text.rlike(r"^\d+$|\|wd\d+\||^(unknown|n/a|none)$")


def resolve_company(name: Column, tenant: Column, overrides: dict[str, str]) -> Column:
    """Override for the tenant, else a plausible given name, else the tenant in title case."""
    table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    spaced = F.initcap(F.regexp_replace(tenant, "[-_]+", " "))
    return F.coalesce(F.element_at(table, F.lower(tenant)), F.when(plausible_name(name), F.trim(name)), spaced)


# Phrases of a page that says the opening is gone.
GONE_PHRASES = r"(?i)no longer (available|accepting)|position (has been )?filled|job (is )?closed|page not found"


def page_verdict(status: Column, body: Column) -> Column:
    return (
        F.when(status.isin(404, 410), "dead").when((status == 200) & F.coalesce(body, F.lit("")).rlike(GONE_PHRASES), "dead")
        .when((status == 200) & (F.length(F.trim(body)) > 0), "alive").otherwise("inconclusive"))


# Kinds of company news, first hit wins: default of an argument.
NEWS_EVENTS = [
    ("layoff", r"\b(layoffs?|laid off|lets? go of|downsiz\w+)\b"),
    ("funding", r"\b(raises?|raised|series [a-z]|seed round|investors?)\b"),
    ("acquisition", r"\b(acquires?|acquired|merges?|merger|takeover)\b"),
    ("expansion", r"\b(opens?|opened|expands?|expanded) (an? |its |new |second )*(office|plant|site|branch|hub|market)s?\b"),
    ("leadership", r"\b(appoints?|appointed|promotes?|promoted|names?)\b.{0,60}\b(ceo|cfo|cto|coo|chief|chair)\b"),
    ("earnings", r"\b(profits?|revenues?|earnings|quarter(ly)?|forecast)\b"),
    ("hiring", r"\b(hiring|hires?|recruits?|vacancies|new jobs)\b"),
]


def news_event(text: Column, rules: list[tuple[str, str]] = NEWS_EVENTS) -> Column:
    return first_match(F.lower(text), rules, "other")
