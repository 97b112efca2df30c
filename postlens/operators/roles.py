"""Domain, admission and role category of a posting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, normalized, words
from .relational import majority_vote

# Fixed values of the skill stage.
MIN_SKILL_SCORE, SECONDARY_RATIO, HARD_WEIGHT, SOFT_WEIGHT = 6, 0.4, 2, 1

# Neutral default rules, in tie-break order: domain -> (title pattern, aliases, vague aliases).
DOMAINS: dict[str, tuple[str, list[str], list[str]]] = {
    "engineering": (r"\bengineer(s|ing)?\b", ["continuous integration", "code review", "unit tests"], ["software"]),
    "product": (r"\bproduct\b", ["product roadmap", "user research"], ["roadmap"]),
    "sales": (r"\bsales\b", ["sales pipeline", "quota"], ["customers"]),
    "data_ml": (r"\bdata\b", ["machine learning", "data pipelines", "statistics"], ["dashboards"]),
}


@dataclass(frozen=True)
class Blocks:
    """Title patterns that stop the classifier, and those that let a title pass all the same."""

    never: str = r"\b(nurse|plumber|chef)\b"
    anyway: str = r"\bdata\b"
    halved: str = "data_ml"  # the domain whose alias score is halved on off-topic titles
    off_topic: str = r"\b(retail|legal)\b"
    on_topic: str = r"\bdata\b"


def classify_domain(df: DataFrame, title: str, text: str, domains: dict = DOMAINS, blocks: Blocks = Blocks()) -> DataFrame:
    """Block list, then title pattern counts, then weighted aliases; adds domain, secondary, method.

    The rules are constants of the plan, so a posting is classified where it is read.
    """
    t = normalized(F.regexp_replace(F.col(title), r"\s*\([^)]*\)", ""))
    names = list(domains)
    title_hits = F.array(*[F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, (p, _, _)) in enumerate(domains.items())])
    width = max((len(a.split()) for _, hard, soft in domains.values() for a in (*hard, *soft)), default=1)
    grams = F.array_distinct(ngrams(words(F.col(text)), width))

    def weight(d: str) -> Column:
        _, hard, soft = domains[d]
        score = F.lit(0)
        if hard:
            score = score + F.size(F.array_intersect(F.col("_grams"), F.array(*[F.lit(a) for a in hard]))) * HARD_WEIGHT
        if soft:
            score = score + F.size(F.array_intersect(F.col("_grams"), F.array(*[F.lit(a) for a in soft]))) * SOFT_WEIGHT
        if d == blocks.halved:
            off = F.col("_t").rlike(blocks.off_topic) & ~F.col("_t").rlike(blocks.on_topic)
            score = F.when(off, F.floor(score / 2)).otherwise(score)
        return score.cast("int")

    ranked = df.withColumns({"_t": t, "_title": F.reverse(F.array_sort(F.filter(title_hits, lambda h: h["n"] > 0)))})
    blocked = F.col("_t").rlike(blocks.never) & ~F.col("_t").rlike(blocks.anyway)
    # Texts are tokenised only where the title did not decide.
    undecided = ~F.coalesce(blocked, F.lit(False)) & (F.size("_title") == 0)
    scored = ranked.withColumn("_grams", F.when(undecided, grams).otherwise(F.array().cast("array<string>")))
    skill_hits = F.array(*[F.struct(weight(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(names)])
    scored = scored.withColumn("_skill", F.reverse(F.array_sort(skill_hits)))
    top = F.col("_skill")[0]
    skill_ok = undecided & (top["n"] >= MIN_SKILL_SCORE)
    floor = F.greatest(top["n"] * SECONDARY_RATIO, F.lit(float(MIN_SKILL_SCORE)))
    none = F.array().cast("array<string>")
    rest = lambda a: F.transform(F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), lambda h: h["d"])
    return scored.withColumns({
        "new_domain": F.when(blocked, None).when(F.size("_title") > 0, F.get("_title", F.lit(0))["d"]).when(skill_ok, top["d"]),
        "secondary": F.when(blocked, none).when(F.size("_title") > 0, rest(F.col("_title")))
        .when(skill_ok, F.transform(F.filter(F.slice("_skill", 2, len(names)), lambda h: h["n"] >= floor), lambda h: h["d"])).otherwise(none),
        "method": F.when(blocked, "null_blocked").when(F.size("_title") > 0, "title").when(skill_ok, "skills").otherwise("default"),
    }).drop("_t", "_title", "_grams", "_skill")


# Neutral default admission rules.
HARD_REJECTS = [("hard:other_trade", r"\b(plumber|chef)\b"), ("hard:no_opening", r"\bgeneral interest\b")]
EVIDENCE_RULES = [  # (rule, title pattern, positive phrases, negative phrases, needed, quarantine only)
    ("evidence:advisor", r"\badvisor\b", ["data", "analysis", "dashboards"], ["door to door"], 2, False),
]
ACCEPT_RULES = [("core:data", r"\bdata\b"), ("core:analysis", r"\banaly(st|tics|sis)\b")]


def admit_roles(df: DataFrame, title: str, text: str, hard=HARD_REJECTS, evidence=EVIDENCE_RULES, accept=ACCEPT_RULES) -> DataFrame:
    """Admission status, rule, confidence and the signals that led to it."""
    t, body = F.trim(F.coalesce(normalized(F.col(title)), F.lit(""))), F.lower(F.coalesce(F.col(text), F.lit("")))
    empty = F.array().cast("array<string>")

    def outcome(status, rule, confidence, pos=None, neg=None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(status).alias("status"), F.lit(rule).alias("rule_id"), lit(confidence).cast("double").alias("confidence"),
                        (empty if pos is None else pos).alias("positive"), (empty if neg is None else neg).alias("negative"))

    def found(phrases: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(body, p)) if phrases else empty

    decision = F.when(t == "", outcome("rejected", "empty_title", 1.0))
    for rule, pattern in hard:
        decision = decision.when(t.rlike(pattern), outcome("rejected", rule, 1.0))
    parked = []
    for rule, pattern, good, bad, needed, quarantine_only in evidence:
        hit = t.rlike(pattern)
        if quarantine_only:
            parked.append((hit, outcome("quarantine", rule, 0.25)))
            continue
        pos, neg = found(good), found(bad)
        decision = decision.when(hit & (F.size(neg) > 0), outcome("rejected", rule, 0.95, pos, neg))
        decision = decision.when(hit & (F.size(pos) >= needed), outcome("accepted_evidence", rule, F.least(F.lit(0.98), F.lit(0.72) + F.size(pos) * 0.06), pos))
        decision = decision.when(hit, outcome("quarantine", rule, 0.45, pos))
    for rule, pattern in accept:
        decision = decision.when(t.rlike(pattern), outcome("accepted_core", rule, 0.99))
    for hit, parked_outcome in parked:
        decision = decision.when(hit, parked_outcome)
    return df.withColumn("scope", decision.otherwise(outcome("rejected", "no_scope_match", 0.99)))


# Words that stand before or after a title without changing the role: defaults of arguments.
LEADING_WORDS = ["senior", "junior", "lead", "chief", "assistant"]
TRAILING_WORDS = ["remote", "hybrid", "i", "ii", "iii"]
CATEGORY_RULES = [(None, r"\bdata engineer", "data_engineering"), (None, r"\banalyst\b", "data_analytics")]


def strip_title(title: Column, leading: list[str] = LEADING_WORDS, trailing: list[str] = TRAILING_WORDS) -> Column:
    """Title up to its first comma, without one leading and one trailing word of the lists."""
    either = lambda words_: "|".join(sorted(words_, key=len, reverse=True))
    head = F.trim(F.split_part(title, F.lit(","), F.lit(1)))
    short = F.regexp_replace(head, rf"(?i)^(?:{either(leading)})\.?\s+", "")
    return F.trim(F.regexp_replace(short, rf"(?i)[\s-]+(?:{either(trailing)})\s*$", ""))


def categorize_roles(df: DataFrame, cache: DataFrame, title: str = "role_name", rules=CATEGORY_RULES, leading: list[str] = LEADING_WORDS, trailing: list[str] = TRAILING_WORDS) -> DataFrame:
    """Company+title cache, title vote, stripped-title vote, domain rules, fallback rules.

    ``cache`` has (company_key, title_key, role_category).
    """
    votes = majority_vote(cache.filter(F.col("role_category").isNotNull()), "title_key", "role_category").select("title_key", "role_category")
    exact = cache.groupBy("company_key", "title_key").agg(F.min("role_category").alias("_c1"))
    low = F.lower(F.trim(title))
    keyed = df.withColumns({"title_key": low, "_stripped": F.lower(strip_title(F.col(title), leading, trailing))})
    out = (
        keyed.join(exact, ["company_key", "title_key"], "left").join(votes.withColumnRenamed("role_category", "_c2"), "title_key", "left")
        .join(votes.select(F.col("title_key").alias("_stripped"), F.col("role_category").alias("_c3")), "_stripped", "left"))
    by_rule = None
    for domain, pattern, category in sorted(rules, key=lambda x: x[0] is None):
        hit = low.rlike(pattern) if domain is None else low.rlike(pattern) & (F.col("domain") == domain)
        by_rule = (F if by_rule is None else by_rule).when(hit, F.lit(category))
    out = out.withColumn("_c4", by_rule)
    return out.withColumns({
        "new_category": F.coalesce("_c1", "_c2", "_c3", "_c4"),
        "category_source": F.when(F.col("_c1").isNotNull(), "cache").when(F.col("_c2").isNotNull(), "title_vote").when(F.col("_c3").isNotNull(), "stripped_vote").when(F.col("_c4").isNotNull(), "rule"),
    }).drop("_c1", "_c2", "_c3", "_c4", "_stripped")
