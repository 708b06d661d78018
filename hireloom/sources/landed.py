"""Landed responses of job boards normalised to postings.

A landed table has (company, body, ...); a normaliser turns it into the columns of POSTING. JSON nulls and missing fields become
empty strings. A body that can't be read gives no posting and never fails the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hireloom.functions.ids import posting_id
from hireloom.functions.text import html_unescape
from hireloom.functions.urls import is_binary_url
from hireloom.schema import DESCRIPTION_LIMIT
from hireloom.sources.html import listing

GREENHOUSE = "struct<jobs:array<struct<id:bigint,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string>>>"
LEVER = "array<struct<id:string,text:string,categories:struct<location:string>,hostedUrl:string,descriptionPlain:string,createdAt:bigint>>"
ASHBY = "struct<jobs:array<struct<id:string,title:string,location:string,jobUrl:string,descriptionPlain:string,publishedAt:string>>>"
WORKDAY = "struct<total:int,jobPostings:array<struct<title:string,locationsText:string,externalPath:string,postedOn:string>>>"

Normaliser = Callable[[DataFrame], DataFrame]
_SOURCES: dict[str, Normaliser] = {}


def register_source(name: str, normaliser: Normaliser) -> None:
    """Adds or replaces the normaliser of a kind of board."""
    _SOURCES[name] = normaliser


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _postings(df: DataFrame, native: Column, title: Column, location: Column, url: Column, description: Column, posted_at: Column, tier: int, id_location: Column | None = None) -> DataFrame:
    title, location, url = _text(title), _text(location), _text(url)
    return df.select(
        posting_id(F.col("company"), native, url, title, location if id_location is None else id_location).alias("id"), "company", title.alias("title"), location.alias("location"), url.alias("url"),
        F.substring(_text(description), 1, DESCRIPTION_LIMIT).alias("description"), _text(posted_at).alias("posted_at"), F.lit(tier).alias("source_tier"),
    )


def greenhouse(landed: DataFrame) -> DataFrame:
    jobs = landed.select("company", F.explode(F.from_json("body", GREENHOUSE)["jobs"]).alias("j")).where("j.id is not null")
    return _postings(jobs, F.col("j.id").cast("string"), F.col("j.title"), F.col("j.location.name"), F.col("j.absolute_url"), html_unescape(_text(F.col("j.content"))), F.col("j.updated_at"), 0)


def lever(landed: DataFrame) -> DataFrame:
    jobs = landed.select("company", F.explode(F.from_json("body", LEVER)).alias("j"))
    return _postings(jobs, F.col("j.id"), F.col("j.text"), F.col("j.categories.location"), F.col("j.hostedUrl"), F.col("j.descriptionPlain"), F.col("j.createdAt"), 0)


def ashby(landed: DataFrame) -> DataFrame:
    jobs = landed.select("company", F.explode(F.from_json("body", ASHBY)["jobs"]).alias("j"))
    return _postings(jobs, F.col("j.id"), F.col("j.title"), F.col("j.location"), F.col("j.jobUrl"), F.col("j.descriptionPlain"), F.col("j.publishedAt"), 0)


def workday(landed: DataFrame, max_jobs: int = 2000) -> DataFrame:
    """From pages (company, base_url, offset, body): pages below the total of the first page and the cap, up to the first empty one."""
    pages = landed.withColumn("p", F.from_json("body", WORKDAY)).withColumn("n", F.coalesce(F.size("p.jobPostings"), F.lit(0)))
    every = Window.partitionBy("company")  # pages, not postings: at most max_jobs over the page size
    pages = pages.withColumn("total", F.max(F.when(F.col("offset") == 0, F.coalesce("p.total", F.lit(0)))).over(every))
    pages = pages.withColumn("stop", F.min(F.when(F.col("n") <= 0, F.col("offset"))).over(every))
    kept = pages.where((F.col("offset") < F.least(F.greatest(F.coalesce("total", F.lit(0)), F.lit(0)), F.lit(max_jobs))) | (F.col("offset") == 0))
    kept = kept.where(F.col("stop").isNull() | (F.col("offset") < F.col("stop")))
    jobs = kept.select("company", "base_url", F.explode("p.jobPostings").alias("j"))
    url = F.concat("base_url", _text(F.col("j.externalPath")))
    return _postings(jobs, F.col("j.externalPath"), F.col("j.title"), F.col("j.locationsText"), url, F.lit(""), F.col("j.postedOn"), 0, F.lit(""))


def spa(landed: DataFrame, jobs_path: str, fields: dict[str, str]) -> DataFrame:
    """From (company, body) with dotted paths to the array and, in each element, to title, location, url, id and description, the same for all rows."""
    config = F.create_map(*[F.lit(x) for kv in {"jobs_path": jobs_path, **fields}.items() for x in kv])
    return spa_by_config(landed.withColumn("config", config))


def spa_by_config(landed: DataFrame) -> DataFrame:
    """From (company, body, config): each row's config names its own dotted paths (jobs_path, title, location, url, id, description)."""
    path = F.coalesce(F.col("config")["jobs_path"], F.lit(""))
    array = F.when(path == "", F.col("body")).otherwise(F.call_function("get_json_object", F.col("body"), F.concat(F.lit("$."), path)))
    jobs = landed.select("company", "config", F.explode(F.from_json(array, "array<string>")).alias("j"))
    at = lambda name, usual: F.coalesce(F.call_function("get_json_object", F.col("j"), F.concat(F.lit("$."), F.coalesce(F.col("config")[name], F.lit(usual)))), F.lit(""))
    optional = lambda name: F.when(F.coalesce(F.col("config")[name], F.lit("")) == "", "").otherwise(at(name, name))
    return _postings(jobs, optional("id"), at("title", "title"), at("location", "location"), at("url", "url"), optional("description"), F.lit(""), 2)


def html_by_config(landed: DataFrame) -> DataFrame:
    """From (company, url, body, config): listing pages, each with the selectors of its own config (job_item, title, link, location)."""
    return listing(landed.select("company", "url", F.col("body").alias("html"), "config"), None).drop("pos")


def workday_pages(landed: DataFrame) -> DataFrame:
    """From (company, url, offset, body): pages of boards whose jobs lie below ``url``; a page without offset is the first one."""
    return workday(landed.select("company", F.coalesce("url", F.lit("")).alias("base_url"), F.coalesce("offset", F.lit(0)).alias("offset"), "body"))


def with_details(rows: DataFrame, details: DataFrame, limit: int, order: str) -> DataFrame:
    """Adds descriptions from detail pages (url, text) to the first ``limit`` rows of each company; binary and empty links use up their place."""
    # The last place of each company that counts: ranks are cut off in each task, so no company is sorted as a whole.
    place = F.struct(order, "url")  # places of equal order follow their URLs
    ranks = rows.select("company", place.alias("_p")).withColumn("_n", F.row_number().over(Window.partitionBy("company").orderBy("_p"))).where(F.col("_n") <= limit)
    last = ranks.groupBy(F.col("company").alias("_c")).agg(F.max("_p").alias("_last"))
    near = rows.join(last, F.col("company") == F.col("_c"), "left")
    wanted = (place <= F.col("_last")) & (F.col("url") != "") & ~is_binary_url(F.col("url"))
    texts = details.groupBy(F.col("url").alias("_u")).agg(F.first("text").alias("_t"))
    joined = near.withColumn("_want", F.when(wanted, F.col("url"))).join(texts, F.col("_want") == F.col("_u"), "left")
    return joined.withColumn("description", F.substring(F.coalesce("_t", "description"), 1, DESCRIPTION_LIMIT)).drop("_c", "_last", "_want", "_u", "_t")


def normalise_all(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, skipped) of (company, ats, body, and as their kinds need them url, offset and config): each registered kind by its
    normaliser; companies of other kinds are skipped."""
    for name, kind in (("url", "string"), ("offset", "int"), ("config", "map<string,string>")):
        if name not in landed.columns:
            landed = landed.withColumn(name, F.lit(None).cast(kind))
    parts = [f(landed.where(F.col("ats") == name)) for name, f in _SOURCES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    skipped = landed.where(~F.coalesce(F.col("ats").isin(list(_SOURCES)), F.lit(False))).select("company", F.lit("skipped").alias("status")).distinct()
    return out, skipped


def jsearch(landed: DataFrame) -> DataFrame:
    """Candidates (name, url) of landed search results; nameless ones go."""
    kind = "struct<data:array<struct<employer_name:string,employer_website:string>>>"
    items = landed.select(F.explode(F.from_json("body", kind)["data"]).alias("d"))
    return items.where("d.employer_name <> ''").select(F.col("d.employer_name").alias("name"), _text(F.col("d.employer_website")).alias("url"))


def search_plan(spark: SparkSession, roles: tuple[str, ...], locations: tuple[str, ...], most_roles: int = 2) -> DataFrame:
    """(pos, query): the searches of a run, the first roles at the first location; none without a location."""
    made = [(i, f"{r} in {locations[0]}") for i, r in enumerate(roles[:most_roles])] if locations else []
    return spark.createDataFrame(made, "pos int, query string")


for _name, _f in (("greenhouse", greenhouse), ("lever", lever), ("ashby", ashby), ("workday", workday_pages), ("spa", spa_by_config), ("html", html_by_config)):
    register_source(_name, _f)


def outcomes(landed: DataFrame, postings: DataFrame) -> DataFrame:
    """(company, status, jobs_found, error) of a run from responses (company, ats, status_code, body) and the postings they gave.

    One company's failure is one row and stops no other: kinds without normaliser are skipped, refusals blocked, broken or missing
    bodies errors, 304 unchanged, all else ok.
    """
    found = postings.groupBy("company").agg(F.count(F.lit(1)).alias("_n"))
    code, body = F.col("status_code"), F.col("body")
    readable = F.coalesce(F.when(F.col("ats") == "html", body != "").otherwise(F.schema_of_variant(F.try_parse_json(body)).isNotNull()), F.lit(False))
    status = (
        F.when(~F.coalesce(F.col("ats").isin(list(_SOURCES)), F.lit(False)), "skipped").when(code == 304, "unchanged").when(code.isin(401, 403, 451), "blocked").when(code.between(200, 299) & readable, "ok").otherwise("error")
    )
    error = F.when(status == "error", F.when(code.between(200, 299), "unreadable body").otherwise(F.concat(F.lit("status "), F.coalesce(code.cast("string"), F.lit("none"))))).when(status == "blocked", F.concat(F.lit("status "), code.cast("string"))).otherwise("")
    ranked = landed.select("company", status.alias("status"), error.alias("error"))
    worst = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("error", "blocked", "ok", "unchanged", "skipped")) for x in (k, i)]), F.col("status"))
    one = ranked.groupBy("company").agg(F.min_by(F.struct("status", "error"), F.struct(worst, "error")).alias("_s"))
    return one.join(found, "company", "left").select("company", F.col("_s.status").alias("status"), F.when(F.col("_s.status") == "ok", F.coalesce("_n", F.lit(0))).otherwise(0).cast("int").alias("jobs_found"), F.col("_s.error").alias("error"))
