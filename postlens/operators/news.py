"""Company news snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_tokens, news_event, words
from .relational import dedupe_best


def classify_events(df: DataFrame, text: str, url: str, company: str, order: list[Column]) -> DataFrame:
    """Type of each snippet that names the company; one row per address (query string ignored)."""
    address = F.lower(F.concat(F.regexp_replace(F.try_parse_url(F.col(url), F.lit("HOST")), r"^www\.", ""), F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))))
    mentioned = F.size(F.array_except(name_tokens(F.col(company)), words(F.col(text)))) == 0
    typed = df.withColumns({"event_type": news_event(F.col(text)), "address": address}).filter(mentioned & F.col("address").isNotNull())
    return dedupe_best(typed, ["address"], order)
