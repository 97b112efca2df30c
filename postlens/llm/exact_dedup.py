"""Exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pack


def content_sort(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, salts: int = 8) -> DataFrame:
    """One row per input row: row (the whole input row), text_sha256, keep_id, group_size, kept.

    Rows are range-partitioned by sampled splitters over (leading characters, digest, salt)
    of the normalised text and sorted outside memory by those and the text itself, so equal
    texts are neighbours; the window over the sorted run compares each text in full with the
    one before it and ranks the run by ``key``.  The splitters are short, so the sample the
    driver sees does not grow with the texts.  The salt comes from ``key``: a text that fills
    a third of the table is cut into ``salts`` runs, whose first and last rows alone are then compared.

    ``keep`` is "smallest" or "largest".  A null text counts as empty.  Of rows equal in text
    and ``key`` exactly one stays; a null ``key`` loses to any other.  An empty table gives an
    empty result.  Extra columns ride along inside ``row`` whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    whole = pack(docs)
    row = F.col("row")
    body = F.coalesce(row[text].cast("string"), F.lit(""))
    body = normalise(body) if normalise else body
    ident = row[key]

    keyed = whole.withColumns({"lead": F.substring(body, 1, 24), "digest": F.xxhash64(body), "salt": F.coalesce(F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"), F.lit(0))})
    dealt = keyed.repartitionByRange("lead", "digest", "salt")
    run = Window.partitionBy("lead", "digest", "salt", "body").orderBy(F.col("ident").asc_nulls_last() if keep == "smallest" else F.col("ident").desc_nulls_last())
    sorted_rows = dealt.withColumns({"body": body, "ident": ident}).withColumns({"place": F.row_number().over(run), "last": F.lead(F.lit(1)).over(run).isNull()})
    rows = sorted_rows.select("row", "ident", "salt", "place", "last", F.coalesce(F.sha2("body", 256), F.lit("")).alias("text_sha256"), F.octet_length("body").alias("n_bytes"))

    # None of the keys can be null, so both readers of the sorted rows share one exchange of the texts.
    # A run's first row is its best, the place of its last row its length: two short rows a run are all that is compared across runs.
    text_key = ["text_sha256", "n_bytes"]
    ends = rows.filter("place = 1 OR last").select(*text_key, "salt", "ident", "place", "last")
    head = F.struct(F.col("ident").isNull().alias("none"), "ident", "salt") if keep == "smallest" else F.struct(F.col("ident").isNotNull().alias("some"), "ident", "salt")
    best = F.min if keep == "smallest" else F.max
    groups = ends.groupBy(*text_key).agg(best(F.when(F.col("place") == 1, head)).alias("winner"), F.sum(F.when(F.col("last"), F.col("place"))).alias("group_size"), F.collect_set("salt").alias("salts"))
    # The outcome goes back to each run by itself, so a text that fills a third of the table meets it in ``salts`` tasks.
    outcome = groups.select(*text_key, F.explode("salts").alias("salt"), "winner", "group_size")
    joined = rows.join(outcome, [*text_key, "salt"])
    kept = (F.col("place") == 1) & (F.col("salt") == F.col("winner.salt"))
    return joined.select("row", "text_sha256", F.col("winner.ident").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return content_sort(docs, **options).filter("kept").select("row.*")
