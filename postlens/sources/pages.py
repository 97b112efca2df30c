"""Captured pages: structured job data, acceptance, sitemaps, text dumps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import US_STATES, blank_to_null
from ..functions.text import org_match, strip_html
from ..operators.relational import dedupe_best, distinct_in_parts
from ..session import cut_lineage

_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"
MIN_TEXT = 100


def extract_jsonld(pages: DataFrame, key: str = "page_id", html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """(key, posting) for every object of the wanted type: several scripts per page, arrays,
    ``@graph`` and nested ``mainEntity`` objects to any depth; unreadable scripts are skipped."""
    scripts = pages.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1))).alias("raw"))
    docs = scripts.select(key, F.try_parse_json(F.trim("raw")).alias("v")).filter(F.col("v").isNotNull())

    def listed(v: Column) -> Column:
        """A variant as an array of variants: itself when it is not a list."""
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))

    level = cut_lineage(docs.select(key, F.explode(listed(F.col("v"))).alias("v")))
    found = level
    while not level.isEmpty():  # ends: every level is inside the one before
        inner = F.concat(*[F.coalesce(F.transform(F.array(F.try_variant_get("v", path, "variant")), lambda x: x), F.array().cast("array<variant>")) for path in ("$['@graph']", "$.mainEntity", "$.itemListElement", "$.item")])
        level = cut_lineage(level.select(key, F.explode(F.filter(inner, lambda x: x.isNotNull())).alias("w")).select(key, F.explode(listed(F.col("w"))).alias("v")))
        found = found.unionByName(level)
    types = F.coalesce(F.try_variant_get("v", "$['@type']", "array<string>"), F.array(F.try_variant_get("v", "$['@type']", "string")))
    text = lambda path: F.try_variant_get("v", path, "string")
    first = lambda *paths: F.coalesce(*[blank_to_null(text(p)) for p in paths])
    return found.filter(F.array_contains(types, kind)).select(
        key, first("$.title").alias("title"), first("$.hiringOrganization.name", "$.hiringOrganization").alias("organization"),
        first("$.jobLocation.address.addressLocality", "$.jobLocation[0].address.addressLocality").alias("city"),
        first("$.jobLocation.address.addressRegion", "$.jobLocation[0].address.addressRegion").alias("region"),
        first("$.jobLocation.address.addressCountry.name", "$.jobLocation.address.addressCountry", "$.jobLocation[0].address.addressCountry", "$.applicantLocationRequirements.name").alias("country"),
        strip_html(text("$.description")).alias("description"), F.to_date(F.substring(text("$.datePosted"), 1, 10)).alias("posted_date"),
        F.try_to_timestamp(F.substring(text("$.validThrough"), 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("valid_through"),
        first("$.identifier.value", "$.identifier").alias("identifier"), first("$.url").alias("url"), first("$.employmentType", "$.employmentType[0]").alias("employment_type"),
        (F.upper(text("$.jobLocationType")) == "TELECOMMUTE").alias("remote"))


def brand_owners(brands: DataFrame, depth: int = 16) -> DataFrame:
    """(brand, owner) for every owner up the chain of a table of (brand, parent); circles end where they close."""
    spark = brands.sparkSession
    return spark.sql(f"""
        WITH RECURSIVE up (brand, owner, seen) AS (
            SELECT brand, parent, array(brand, parent) FROM {{brands}} WHERE brand IS NOT NULL AND parent IS NOT NULL
            UNION ALL
            SELECT u.brand, b.parent, array_append(u.seen, b.parent) FROM up u JOIN {{brands}} b ON b.brand = u.owner
            WHERE b.parent IS NOT NULL AND NOT array_contains(u.seen, b.parent) AND size(u.seen) < {depth})
        SELECT DISTINCT brand, owner FROM up""", brands=brands)


def site_of(url: Column) -> Column:
    """The registered domain of an address, taken as the last two labels of its host."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def attribute_brands(postings: DataFrame, brands: DataFrame, blocked: list[str] = ()) -> DataFrame:
    """Adds attribution: host, parent or brand, null where the organisation may not be trusted.

    The organisation is the host's company, or one that ``brands`` (brand, parent; lower case) puts under it.
    Any other name counts only if it is not ``blocked`` and the page lies on the host's own
    site (``careers_url``); the posting is then the stated brand's.
    """
    owned = brand_owners(brands)
    org, home = F.lower(F.trim("organization")), F.lower(F.trim("company_name"))
    named = postings.withColumns({"_org": org, "_home": home})
    parents = named.filter(F.col("_org").isNotNull()).select("_org", "_home").distinct().join(owned.select(F.col("brand").alias("_org"), F.col("owner").alias("_home")), ["_org", "_home"]).withColumn("_owned", F.lit(True))
    joined = named.join(parents, ["_org", "_home"], "left")
    plain = F.coalesce("_org", F.lit("")) != ""
    own_site = F.coalesce(site_of(F.col("url")) == site_of(F.col("careers_url")), F.lit(False))
    attribution = F.when(plain & org_match(F.col("company_name"), F.col("organization")), "host").when(plain & F.col("_owned"), "parent").when(plain & ~F.col("_org").isin(*[b.lower() for b in blocked]) & own_site, "brand")
    return joined.withColumn("attribution", attribution).drop("_org", "_home", "_owned")


def accept_postings(postings: DataFrame, hosts: DataFrame, as_of: str, key: str = "page_id", target: str = r"(?i)\b(data|analy|engineer|scientist)", brands: DataFrame | None = None, blocked: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, counts by rejection reason); ``hosts`` has (key, host_id, company_name).

    With ``brands`` (see ``attribute_brands``; ``hosts`` then has careers_url too) subsidiaries and brands are
    accepted, and the counts say how many by which attribution.
    """
    j = postings.join(hosts, key)
    if brands is not None:
        j = attribute_brands(j, brands, blocked)
    country = F.lower(F.coalesce("country", F.lit("")))
    in_us = country.isin("us", "usa", "united states") | ((country == "") & F.upper(F.coalesce("region", F.lit(""))).isin(US_STATES))
    reason = (
        F.when(F.coalesce("title", F.lit("")) == "", "non_target_role").when(~F.col("title").rlike(target), "non_target_role")
        .when(~in_us, "no_us_evidence").when(F.col("organization").isNull() | ~org_match(F.col("company_name"), F.col("organization")) if brands is None else F.col("attribution").isNull(), "organization_mismatch")
        .when(F.length(F.coalesce("description", F.lit(""))) < MIN_TEXT, "short_description")
        .when(F.col("valid_through") < F.lit(as_of).cast("date"), "expired"))
    judged = j.withColumn("reject_reason", reason)
    url = F.coalesce("url", F.col(key).cast("string"))
    accepted = judged.filter(F.col("reject_reason").isNull()).withColumn("source_id", F.concat_ws("|", "host_id", F.coalesce("identifier", F.substring(F.sha2(url, 256), 1, 24)))).drop("reject_reason")
    taken = F.lit("accepted") if brands is None else F.concat(F.lit("accepted_by_"), "attribution")
    return accepted, judged.groupBy(F.coalesce("reject_reason", taken).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


JOB_PATH = r"(?i)/(?:jobs?|careers?|openings?|positions?|vacanc)[/-]"
HUB_PATH = r"(?i)/(?:jobs|careers|opportunities|search-jobs)/?(?:[?#].*)?$"  # a list of jobs, not a job


def expand_sitemaps(docs: DataFrame, roots: DataFrame, job_path: str = JOB_PATH, hub_path: str = HUB_PATH) -> DataFrame:
    """Job-shaped addresses, hubs left out, reachable from root sitemaps over captured (url, xml) documents.

    Goes on until a level has no sitemap that was not read before, so loops end too.
    """
    locs = docs.select(F.col("url").alias("parent"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url"))
    kinds = docs.select("url").distinct().withColumn("_is_map", F.lit(True))
    edges = locs.join(kinds, "url", "left").select("parent", "url", F.coalesce("_is_map", F.lit(False)).alias("_is_map"))
    edges = cut_lineage(edges)
    level = seen = cut_lineage(roots.select("url").distinct())
    leaves = roots.select("url").limit(0)
    while not level.isEmpty():
        children = edges.join(level.withColumnRenamed("url", "parent"), "parent").select("url", "_is_map")
        leaves = leaves.unionByName(children.filter(~F.col("_is_map") & F.col("url").rlike(job_path) & ~F.col("url").rlike(hub_path)).select("url"))
        level = cut_lineage(children.filter("_is_map").select("url").distinct().join(seen, "url", "left_anti"))
        seen = seen.unionByName(level)
    return distinct_in_parts(leaves, edges.count())


def split_dump(texts: DataFrame, column: str = "value", begin: str = "=== JOB START ===", end: str = "=== JOB END ===") -> DataFrame:
    """One row per marked block of a text dump; repeats of a block are dropped by hash."""
    pattern = rf"(?s){re.escape(begin)}\s*(.*?)\s*{re.escape(end)}"
    return _distinct_blocks(texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("block")))


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    hashed = blocks.filter(F.trim("block") != "").withColumn("block_hash", F.sha2(F.lower(F.trim(F.regexp_replace("block", r"\s+", " "))), 256))
    return dedupe_best(hashed, ["block_hash"], [F.col("block")])


def read_dump(spark: SparkSession, path: str, begin: str = "=== JOB START ===", end: str = "=== JOB END ===") -> DataFrame:
    """Blocks of dumps of any size: a file is read record by record up to each ``end``, so Spark splits it over tasks.

    A record's block follows the last ``begin`` in it; what stands before, between or after is noise.
    """
    records = spark.read.option("lineSep", end).text(path)
    at = F.expr("value").contains(begin)
    block = F.trim(F.regexp_replace(F.element_at(F.split("value", re.escape(begin)), -1), r"^\s+|\s+$", ""))
    return _distinct_blocks(records.filter(at).select(block.alias("block")))
