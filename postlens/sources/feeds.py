"""Partner feeds: JSON or CSV in, good rows, quarantined rows and counts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_posted_date
from ..operators.relational import dedupe_best

FIELDS = ["id", "title", "description", "location", "url", "posted_date", "salary_min", "salary_max", "employment_type"]
TARGET_TITLES = r"(?i)\b(data|analy|engineer|scientist|product)"
_ROW = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"


def read_raw(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One row per entry with every field as text; unreadable input keeps its raw text."""
    if fmt == "csv":
        # A header may name the columns in any order, so fields are matched by name, not by place.
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
        known = {c.strip().lower(): c for c in raw.columns}
        return raw.select(*[(F.col(f"`{known[f]}`") if f in known else F.lit(None).cast("string")).alias(f) for f in FIELDS], F.lit(None).cast("string").alias("_corrupt"))
    if fmt == "jsonl":
        lines = spark.read.text(path).filter(F.trim("value") != "")
        parsed = lines.select("value", F.from_json("value", _ROW).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
        return parsed.select(*[F.col(f"r.{f}").alias(f) for f in FIELDS], F.when(F.col("bad"), F.col("value")).alias("_corrupt"))
    if fmt == "json":
        # A whole document is an array or {"jobs": [...]}; one file is one row, files spread over tasks.
        docs = spark.read.text(path, wholetext=True)
        shaped = docs.select("value", F.from_json(F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.jobs")), f"array<{_ROW}>").alias("rows"))
        good = shaped.filter(F.col("rows").isNotNull()).select(F.explode("rows").alias("r")).select(*[F.col(f"r.{f}").alias(f) for f in FIELDS], F.lit(None).cast("string").alias("_corrupt"))
        bad = shaped.filter(F.col("rows").isNull()).select(*[F.lit(None).cast("string").alias(f) for f in FIELDS], F.col("value").alias("_corrupt"))
        return good.unionByName(bad)
    raise ValueError(f"unknown feed format {fmt}")


def screen(raw: DataFrame, employer: str, tenant: str, target: str = TARGET_TITLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, bad, stats).  A row is bad for its first failing reason; off-target rows are
    counted, not quarantined; repeats of an id are dropped after parsing."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    date = parse_posted_date(F.col("posted_date"))
    reason: Column = (
        F.when(F.col("_corrupt").isNotNull(), "unreadable").when(text("id") == "", "missing_id").when(text("title") == "", "missing_title")
        .when((text("posted_date") != "") & F.col("_date").isNull(), "bad_date").when((text("url") != "") & ~F.col("url").rlike("(?i)^https?://"), "bad_url"))
    judged = raw.withColumn("_date", date).withColumn("reject_reason", reason)
    outcome = F.when(F.col("reject_reason").isNotNull(), "bad").when(~F.col("title").rlike(target), "non_target").otherwise("good")
    judged = judged.withColumn("outcome", outcome)
    rows = judged.filter(F.col("outcome") == "good").select(
        F.lit("employer_feed").alias("source"), F.concat_ws("|", F.lit(tenant), F.trim("id")).alias("source_id"), F.trim("title").alias("title"), F.lit(employer).alias("company"),
        "location", "description", F.col("url").alias("job_url"), F.col("_date").alias("posted_date"), F.expr("try_cast(salary_min AS double)").alias("salary_min"),
        F.expr("try_cast(salary_max AS double)").alias("salary_max"), "employment_type")
    good = dedupe_best(rows, ["source", "source_id"], [F.col("posted_date").desc_nulls_last(), F.xxhash64("title", "description", "job_url")])
    bad = judged.filter(F.col("outcome") == "bad").select(*FIELDS, "_corrupt", "reject_reason")
    stats = judged.groupBy("outcome", "reject_reason").agg(F.count(F.lit(1)).alias("n"))
    return good, bad, stats


def read_partner_feed(spark: SparkSession, path: str, fmt: str, employer: str, tenant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return screen(read_raw(spark, path, fmt), employer, tenant)
