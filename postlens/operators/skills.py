"""Skill tagging, discovery and promotion.

Aliases are matched by equality on token n-grams, never by running every alias
pattern over every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_id, rounded
from ..functions.text import token_rows, words
from .relational import global_rank

PRIORITY_RANK = {"required": 3, "preferred": 2, "nice-to-have": 1}

# Headings of a skills block, lower case: those that set a priority, those that only
# open a block, those that close one.
PRIORITY_HEADINGS = {"required": ["requirements", "required", "required skills", "qualifications", "minimum qualifications"],
                     "preferred": ["preferred", "preferred qualifications", "preferred skills"], "nice-to-have": ["nice to have", "bonus points", "bonus"]}
OPENING = ["skills", "technical skills", "tools"]
CLOSING = ["benefits", "about us", "about the company", "responsibilities", "compensation", "what we offer", "perks"]
BULLET = r"^\s*(?:[-*•·]|\d+[.)])\s+"


def _heading(names: list[str]) -> str:
    return r"^[ \t]*(?:" + "|".join(names) + r")[ \t]*:?[ \t]*$"


# Words that rule a line ending in a colon, and a line on which they stand; the first that fits counts.
RULING_WORDS = {"nice-to-have": r"nice[ -]to[ -]have|bonus", "preferred": r"preferred", "required": r"required|requirements|qualifications|must have"}
_RULING_LINE = r"^(?![ \t]*(?:[-*•·]|\d+[.)]))[^\n:]{0,60}\b(?:" + "|".join(RULING_WORDS.values()) + r")\b[^\n:]{0,40}:[ \t]*$"


def ruled_by(text: Column) -> Column:
    """The priority whose word stands in a text; null if none does."""
    return F.coalesce(*[F.when(F.lower(text).rlike(rf"\b(?:{words_})\b"), F.lit(name)) for name, words_ in RULING_WORDS.items()])


def section_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Lines of each text with in_block, priority and bullet.

    The text is cut in front of its headings, first those that set a priority,
    then those that open or close a block, so every piece starts with the heading
    that rules it; nothing is carried from line to line.  A heading is a line of the lists, or one
    that is no bullet, ends in a colon and holds a ruling word.  A ruling word on a line of its own
    block goes before the heading.
    """
    ruled = [h for names in PRIORITY_HEADINGS.values() for h in names]
    ruling = f"{_heading(ruled)}|{_RULING_LINE}"
    pieces = df.select(*keep, F.explode(F.split(text, f"(?im)(?={ruling})")).alias("_p"))
    top = F.regexp_extract("_p", r"^([^\n]*)", 1)
    first = F.lower(F.trim(F.regexp_extract("_p", r"^[ \t]*([^\n:]*)", 1)))
    priority = None
    for name, names in PRIORITY_HEADINGS.items():
        priority = (F if priority is None else priority).when(first.isin(names), F.lit(name))
    priority = priority.when(top.rlike(f"(?i){_RULING_LINE}"), ruled_by(first))
    parts = pieces.select(*keep, priority.alias("_rank"), F.explode(F.split("_p", f"(?im)(?={_heading(OPENING + CLOSING)})")).alias("_q"))
    head, line = F.lower(F.trim(F.regexp_extract("_q", r"^[ \t]*([^\n:]*)", 1))), F.regexp_extract("_q", r"^([^\n]*)", 1)
    block = F.when(head.isin(OPENING), True).when(head.isin(CLOSING), False).otherwise(head.isin(ruled) | line.rlike(f"(?i){_RULING_LINE}"))
    lines = parts.select(*keep, block.alias("in_block"), F.coalesce("_rank", F.lit("required")).alias("_section"), F.explode(F.split("_q", "\n")).alias("line"))
    shown = lines.filter((F.trim("line") != "") & ~F.trim("line").rlike(f"(?i){_heading(ruled + OPENING + CLOSING)}|{_RULING_LINE}"))
    return shown.select(*keep, "in_block", F.coalesce(ruled_by(F.col("line")), "_section").alias("priority"), "line", F.col("line").rlike(BULLET).alias("bullet"))


def alias_table(skills: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(alias, skill_id, ambiguous): skill names plus extra aliases, tokenised like the text."""
    names = skills.select(F.array_join(words(F.col("skill_name")), " ").alias("alias"), "skill_id", F.lit(False).alias("ambiguous"))
    return names if aliases is None else names.unionByName(aliases.select(F.array_join(words(F.col("alias")), " ").alias("alias"), "skill_id", "ambiguous")).distinct()


def match_aliases(df: DataFrame, keep: list[str], text: Column, aliases: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``keep`` joined with the aliases found in ``text``.

    Equality on the first word (and ``on``) finds the alias rows; the words after
    it are compared in the same join.
    """
    on = on or []
    alias_words = F.split("alias", " ")
    width = aliases.agg(F.max(F.size(alias_words))).first()[0] or 1  # the alias table only, never the texts
    parts = aliases.withColumns({f"a{n}": F.get(alias_words, F.lit(n - 1)) for n in range(1, width + 1)})
    toks = token_rows(df, keep, text, width)
    cond = toks["w1"] == parts["a1"]
    for c in on:
        cond = cond & (toks[c] == parts[c])
    for n in range(2, width + 1):
        cond = cond & (parts[f"a{n}"].isNull() | (toks[f"w{n}"] == parts[f"a{n}"]))
    return toks.join(parts, cond).select(*[toks[c] for c in keep], *[parts[c] for c in aliases.columns if c not in on and c != "alias"])


def extract_skills_sectioned(df: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, skill, priority): section decides; otherwise any mention counts as required."""
    lines = section_lines(df, [key], text)
    hits = match_aliases(lines, [key, "in_block", "priority", "bullet"], F.col("line"), aliases).filter(~F.col("ambiguous") | F.col("bullet"))
    rank = F.coalesce(*[F.when(F.col("priority") == p, n) for p, n in PRIORITY_RANK.items()])
    best = hits.groupBy(key, "skill_id").agg(F.max(F.when(F.col("in_block"), rank)).alias("_r"))
    back = F.when(F.col("_r") == 2, "preferred").when(F.col("_r") == 1, "nice-to-have").otherwise("required")
    return best.select(key, "skill_id", back.alias("skill_priority"))


def tag_skills(postings: DataFrame, aliases: DataFrame, existing: DataFrame, mode: str = "untagged", since: str | None = None,
               min_length: int = 500, id_prefix: str = "JS") -> DataFrame:
    """New bridge rows for posting texts: (domain, alias) equality on n-grams.

    ``aliases`` has (domain, alias, skill_id).  ``untagged`` looks only at
    postings without any skill, ``backfill`` at all of them; existing pairs are
    never produced again.
    """
    scope = postings.filter((F.col("status") == "raw") & (F.col("data_tier") == 1) & F.col("domain").isNotNull() & (F.length("description_text") > min_length))
    if since is not None:
        scope = scope.filter(F.col("ingested_at") >= F.lit(since).cast("date"))
    if mode == "untagged":
        scope = scope.join(existing.select("job_id"), "job_id", "left_anti")
    elif mode != "backfill":
        raise ValueError(f"unknown mode {mode}")
    pairs = match_aliases(scope, ["job_id", "domain"], F.col("description_text"), aliases, on=["domain"]).select("job_id", "skill_id").distinct()
    return pairs.join(existing.select("job_id", "skill_id"), ["job_id", "skill_id"], "left_anti").select(
        md5_id(id_prefix, F.col("job_id"), F.col("skill_id")).alias("job_skills_id"), "job_id", "skill_id",
        F.lit("required").alias("skill_priority"), F.lit(0.9).alias("confidence"), F.lit("sql_extract").alias("extraction_src"))


# Phrases after which a skill tends to be named: default of an argument.
SIGNAL_PHRASES = ["experience with", "experience in", "knowledge of", "skilled in", "fluent in", "hands-on with", "comfortable with", "trained in"]
NOISE = ["data", "team", "work", "tools", "the", "business", "systems", "technology", "software"]
LONGEST_TERM = 40


def _named_terms(line: Column, phrases: list[str]) -> Column:
    """What follows a signal phrase on a line, up to the next comma, bracket or end of sentence."""
    after = F.slice(F.split(line, rf"(?i)\b(?:{'|'.join(phrases)})\s+"), F.lit(2), F.length(line))
    cut = F.transform(after, lambda x: F.trim(F.regexp_extract(x, r"^(.*?)(?:[,;()]|\.(?:\s|$)|$)", 1)))
    return F.filter(cut, lambda x: x.rlike("^[A-Za-z]") & F.length(x).between(2, LONGEST_TERM))


def discover_skills(df: DataFrame, known: DataFrame, key: str = "job_id", group: str = "company_id", text: str = "description_text", min_jobs: int = 3,
                    phrases: list[str] = SIGNAL_PHRASES, noise: list[str] = NOISE) -> DataFrame:
    """Unknown terms named after a signal phrase on bullet lines that mention a known skill.

    Known skills are found by joining the lines' words with the taxonomy, and known
    terms leave by an anti-join: the taxonomy is never gathered anywhere.
    """
    bullets = F.filter(F.split(F.col(text), "\n"), lambda s: s.rlike(BULLET))
    named = df.select(key, group, F.explode(bullets).alias("line")).withColumn("terms", _named_terms(F.col("line"), phrases)).filter(F.size("terms") > 0)
    names = known.select(F.array_join(words(F.col("skill_name")), " ").alias("alias"), F.lit(1).alias("_hit"))
    speaking = match_aliases(named, [key, group, "terms"], F.col("line"), names).select(key, group, F.explode("terms").alias("term"))
    clean = speaking.withColumn("term", F.trim(F.regexp_replace("term", r"\s+", " "), F.lit(" .,;:"))).filter(~F.lower("term").isin(noise))
    fresh = clean.join(known.select(F.lower("skill_name").alias("_k")).distinct(), F.lower("term") == F.col("_k"), "left_anti")
    spelled = F.when((F.upper("term") == F.col("term")) | (F.lower("term") == F.col("term")), F.initcap("term")).otherwise(F.col("term"))
    out = fresh.groupBy(spelled.alias("term")).agg(F.countDistinct(key).alias("job_count"), F.countDistinct(group).alias("company_count"))
    return out.filter(F.col("job_count") >= min_jobs)


def promote_candidates(candidates: DataFrame, skills: DataFrame, min_seen: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """New skill ids, numbered on from the highest existing one, for good candidates."""
    ready = candidates.filter((F.col("status") == "new") & (F.col("seen_count") >= min_seen) & (F.col("confidence") >= min_confidence))
    top = skills.agg(F.coalesce(F.max(F.regexp_replace("skill_id", r"\D", "").try_cast("int")), F.lit(0)).alias("m"))
    numbered = global_rank(ready, "candidate_id", "_n").withColumn("_m", top.scalar())
    number = (F.col("_n") + F.col("_m")).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return numbered.select("candidate_id", "normalized_text", F.concat(F.lit("S"), padded).alias("skill_id"))


def alias_variants(aliases: DataFrame, known: DataFrame, vendors: tuple[str, ...] = ("apache", "amazon", "google", "microsoft")) -> DataFrame:
    """Spelling variants of each alias that do not exist yet."""
    a = F.lower(F.trim("alias"))
    bare = F.regexp_replace(a, rf"^(?:{'|'.join(vendors)})\s+", "")
    variants = F.array(F.regexp_replace(a, r"[\s_-]+", " "), F.regexp_replace(a, r"[\s_-]+", "-"), F.regexp_replace(a, r"[\s_-]+", ""), F.regexp_replace(a, r"[.]", ""), bare)
    fresh = aliases.select("skill_id", F.explode(F.array_distinct(variants)).alias("alias")).filter(F.length("alias") > 1).distinct()
    return fresh.join(known.select(F.lower(F.trim("alias")).alias("alias")), "alias", "left_anti")


def clean_candidates(candidates: DataFrame, exact: list[str], contains: list[str]) -> DataFrame:
    """Candidate profile without stop-listed terms."""
    term = F.lower(F.trim("normalized_text"))
    bad = term.isin(exact)
    for part in contains:
        bad = bad | term.contains(part)
    return candidates.filter(~bad).groupBy(term.alias("term")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence"), 4).alias("avg_confidence"), F.min("example").alias("example"))
