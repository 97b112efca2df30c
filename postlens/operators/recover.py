"""Title, company and place from the head of a pasted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import US_STATES

# How far the head of a text reaches, in lines, for titles and places and for the company.
HEAD_LINES, COMPANY_LINES, MIN_SCORE = 40, 18, 2
TITLE_WORDS = r"(?i)\b(engineer|analyst|scientist|manager|developer|consultant|director|specialist|nurse|executive)\b"
PLACE = r"^([A-Z][A-Za-z .'-]+), ([A-Z]{2})\b"

# What speaks for or against a line being an employer's name: (signal, weight); defaults of an argument.
COMPANY_SIGNALS: list[tuple[str, float]] = [
    (r"^(?:\p{Lu}[\p{L}\p{N}&.'-]*)(?:\s+(?:\p{Lu}[\p{L}\p{N}&.'-]*|\p{N}+|of|and|the|&|(?i:inc|llc|ltd)\.?))*$", 2),  # capitalised throughout
    (r"(?i)\b(?:inc|llc|ltd|corp|gmbh|group|labs|partners)\.?$", 1),
    (r"\s*\S+(?:\s+\S+){7,}", -2),  # eight words or more: a sentence
    (r"[:;/!?]", -2),
    (r"[.]\s+\S", -2),
    (r"^[^\p{L}]*$", -9),
    (r"(?i)\b(?:apply|promoted|applicants?|hiring|posted|salary|remote|hybrid|benefits|requirements)\b", -9),
]


def _head(line: Column) -> Column:
    """A line without what stands after a dot or bar, and without the word for the picture."""
    return F.regexp_replace(F.regexp_extract(line, r"^(.*?)(?:\s+[·•|]\s.*)?$", 1), r"(?i)\s+logo$", "")


def company_score(line: Column, signals: list[tuple[str, float]] = COMPANY_SIGNALS) -> Column:
    """Sum of the weights of the signals found in a line."""
    return sum((F.when(line.rlike(pattern), F.lit(float(weight))).otherwise(0.0) for pattern, weight in signals), F.lit(0.0))


def recover_dims(df: DataFrame, text: str, signals: list[tuple[str, float]] = COMPANY_SIGNALS) -> DataFrame:
    """Title, company, city and state of each text, where they are missing.

    The company is the line of the highest score, the earliest of equals; the title and
    the place are the first lines of their shape.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), F.trim), lambda s: s != "")
    wide = df.withColumn("_lines", F.slice(lines, 1, HEAD_LINES))
    is_title = lambda s: s.rlike(TITLE_WORDS) & F.length(s).between(4, 120)
    is_place = lambda s: s.rlike(PLACE) & F.regexp_extract(s, PLACE, 2).isin(US_STATES)
    # A line that what speaks for it does not lift to the least score is not searched for what speaks against it.
    likely = lambda s: company_score(s, [x for x in signals if x[1] > 0]) >= MIN_SCORE
    heads = F.transform(F.slice("_lines", 1, COMPANY_LINES), lambda s, i: F.struct((-i).alias("o"), _head(s).alias("line")))
    names = F.filter(heads, lambda h: likely(h["line"]) & ~h["line"].rlike(TITLE_WORDS) & ~h["line"].rlike(PLACE))
    ranked = F.transform(names, lambda h: F.struct(company_score(h["line"], signals).alias("score"), h["o"], h["line"]))
    seen = wide.withColumns({"_title": F.get(F.filter("_lines", is_title), F.lit(0)), "_place": F.get(F.filter("_lines", is_place), F.lit(0)), "_best": F.array_max(ranked)})
    bare = lambda c: F.trim(c, F.lit(" -•"))
    found = {
        "title": bare(F.col("_title")),
        "company": F.when(F.col("_best.score") >= MIN_SCORE, bare(F.col("_best.line"))),
        "city": F.when(F.col("_place").isNotNull(), F.regexp_extract("_place", PLACE, 1)),
        "state": F.when(F.col("_place").isNotNull(), F.regexp_extract("_place", PLACE, 2)),
    }
    return seen.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in found.items()}).drop("_lines", "_title", "_place", "_best")
