"""Captured payloads of applicant systems to one landing schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, normalize_employment_type, parse_posted_date, parse_remote_type
from ..functions.text import strip_html

LANDING = ["source", "source_id", "tenant", "title", "company", "location", "description", "job_url", "salary_min", "salary_max", "salary_period",
           "workplace_type", "employment_type", "posted_date", "metadata"]

# Per source: payload schema and where each landing field lives in it (SQL over ``p``).
FIELD_MAPS: dict[str, tuple[str, dict[str, str]]] = {
    "greenhouse": (
        "struct<id:string,title:string,absolute_url:string,updated_at:string,first_published:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>>",
        {"source_id": "p.id", "title": "p.title", "job_url": "p.absolute_url", "location": "p.location.name", "description": "p.content",
         "posted": "coalesce(p.first_published, p.updated_at)", "team": "element_at(p.departments, 1).name"}),
    "lever": (
        "struct<id:string,text:string,hostedUrl:string,createdAt:string,descriptionPlain:string,workplaceType:string,categories:struct<location:string,commitment:string,team:string>,salaryRange:struct<min:double,max:double,interval:string>>",
        {"source_id": "p.id", "title": "p.text", "job_url": "p.hostedUrl", "location": "p.categories.location", "description": "p.descriptionPlain", "posted": "p.createdAt",
         "workplace": "p.workplaceType", "employment": "p.categories.commitment", "team": "p.categories.team", "low": "p.salaryRange.min", "high": "p.salaryRange.max", "period": "p.salaryRange.interval"}),
    "ashby": (
        "struct<id:string,title:string,jobUrl:string,publishedAt:string,descriptionPlain:string,location:string,employmentType:string,isRemote:boolean,department:string>",
        {"source_id": "p.id", "title": "p.title", "job_url": "p.jobUrl", "location": "p.location", "description": "p.descriptionPlain", "posted": "p.publishedAt",
         "workplace": "CASE WHEN p.isRemote THEN 'remote' END", "employment": "p.employmentType", "team": "p.department"}),
    "workday": (
        "struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>,jobDescription:string,remoteType:string,timeType:string,startDate:string>",
        {"source_id": "coalesce(element_at(p.bulletFields, 1), p.externalPath)", "title": "p.title", "job_url": "p.externalPath", "location": "p.locationsText", "description": "p.jobDescription",
         "posted": "p.startDate", "workplace": "p.remoteType", "employment": "p.timeType"}),
    "smartrecruiters": (
        "struct<id:string,name:string,ref:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>,typeOfEmployment:struct<label:string>,jobAd:struct<text:string>>",
        {"source_id": "p.id", "title": "p.name", "job_url": "p.ref", "location": "concat_ws(', ', p.location.city, p.location.region, upper(p.location.country))", "description": "p.jobAd.text",
         "posted": "p.releasedDate", "workplace": "CASE WHEN p.location.remote THEN 'remote' END", "employment": "p.typeOfEmployment.label"}),
    "amazon": (
        "struct<id_icims:string,title:string,job_path:string,posted_date:string,normalized_location:string,description:string,basic_qualifications:string,job_schedule_type:string,team:string>",
        {"source_id": "p.id_icims", "title": "p.title", "job_url": "concat('https://www.amazon.jobs', p.job_path)", "location": "p.normalized_location",
         "description": "concat_ws('\\n', p.description, p.basic_qualifications)", "posted": "p.posted_date", "employment": "p.job_schedule_type", "team": "p.team"}),
    "eightfold": (
        "struct<id:string,name:string,canonicalPositionUrl:string,t_create:string,location:string,job_description:string,work_location_option:string,department:string>",
        {"source_id": "p.id", "title": "p.name", "job_url": "p.canonicalPositionUrl", "location": "p.location", "description": "p.job_description", "posted": "p.t_create",
         "workplace": "p.work_location_option", "team": "p.department"}),
}
_PERIODS = [("hour", "hour"), ("month", "month"), ("year", "year|annum")]


def normalize_payloads(df: DataFrame, source: str) -> DataFrame:
    """Landing rows from (tenant, company, payload) rows of one source."""
    schema, fields = FIELD_MAPS[source]
    parsed = df.withColumn("p", F.from_json("payload", schema)).filter(F.expr(fields["source_id"]).isNotNull() & F.expr(fields["title"]).isNotNull())

    def field(name: str, kind: str = "string") -> Column:
        return F.expr(fields[name]).cast(kind) if name in fields else F.lit(None).cast(kind)

    period = reduce(lambda acc, x: acc.when(F.lower(field("period")).rlike(x[1]), x[0]), _PERIODS[1:], F.when(F.lower(field("period")).rlike(_PERIODS[0][1]), _PERIODS[0][0]))
    return parsed.select(
        F.lit(source).alias("source"), F.concat_ws("|", "tenant", field("source_id")).alias("source_id"), "tenant", F.trim(field("title")).alias("title"), "company",
        blank_to_null(field("location")).alias("location"), strip_html(field("description")).alias("description"), field("job_url").alias("job_url"),
        field("low", "double").alias("salary_min"), field("high", "double").alias("salary_max"), period.alias("salary_period"),
        parse_remote_type(field("workplace")).alias("workplace_type"), normalize_employment_type(field("employment")).alias("employment_type"),
        parse_posted_date(field("posted")).alias("posted_date"), F.map_filter(F.create_map(F.lit("team"), field("team")), lambda k, v: v.isNotNull()).alias("metadata"))


def normalize_all(df: DataFrame, source_col: str = "source") -> DataFrame:
    """All sources of one capture table in one frame."""
    parts = [normalize_payloads(df.filter(F.col(source_col) == s), s) for s in FIELD_MAPS]
    return reduce(lambda a, b: a.unionByName(b), parts)
