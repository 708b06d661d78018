"""Queries over the core operators, each with the SQL that DuckDB runs beside it where SQL can express it."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.common import materialise, scratch_path, table
from hireloom.functions import dates, match, text, urls
from hireloom.functions.ids import posting_id
from hireloom.operators import browse, digest, discovery, health, robots, store
from hireloom.schema import POSTING, STATE
from hireloom.sources import config, html, landed, sitemaps
from hireloom.streaming import first_seen

AS_OF = datetime(2026, 8, 31, 12)
FILTERS = match.Filters(
    roles=("Software Engineer", "Machine Learning Engineer", "Data Scientist", "Customer Manager"), locations=("London", "Bengaluru", "Berlin", "New York City"),
    include_remote=True, experience="0-2 years", max_days_old=60,
)


def _matched() -> Column:
    return match.title_ok(F.col("title"), FILTERS.roles) & match.location_ok(F.col("location"), FILTERS.locations, FILTERS.include_remote)


def match_postings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").where(_matched()).select("row_id")


def experience_filter(spark: SparkSession, sf: str) -> DataFrame:
    ok = match.experience_ok(F.col("title"), F.col("description"), match.max_years(FILTERS.experience))
    return table(spark, sf, "postings").select("row_id", ok.alias("ok"))


def posted_recency(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "postings").select("row_id", "posted_at")
    return df.select("row_id", F.unix_seconds(dates.posted_date(F.col("posted_at"), AS_OF)).alias("posted_s"), dates.posted_recently(F.col("posted_at"), 60, AS_OF).alias("recent"))


def full_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").where(match.matches(FILTERS, AS_OF)).select("row_id")


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """The stored jobs, one row for each id: the first one written."""
    jobs = table(spark, sf, "jobs").select("seq", "id", "company", "title", "location", "url", "posted_at", "first_seen", "matched")
    return store.first_by(jobs.where("id is not null"), "id", "seq").drop("seq")


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "postings").select("row_id", "id", "company", "title", "location", "url", "posted_at", _matched().cast("int").alias("matched"))
    return df


def first_seen_new(spark: SparkSession, sf: str) -> DataFrame:
    """Never-seen postings that match the filters."""
    rows = store.collapse(_batch(spark, sf).where("id is not null"), "row_id").where("matched = 1")
    return rows.join(_state(spark, sf).select("id"), "id", "left_anti").select("id", "company", "title", "location")


def merge_state(spark: SparkSession, sf: str) -> DataFrame:
    return store.merge(_state(spark, sf), _batch(spark, sf), "row_id", "2026-09-01T00:00:00+00:00").state.select("id", "company", "title", "first_seen", "matched")


def merge_new(spark: SparkSession, sf: str) -> DataFrame:
    return store.merge(_state(spark, sf), _batch(spark, sf), "row_id", "2026-09-01T00:00:00+00:00").new.select("id", "company", "title", "first_seen", "matched")


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select(F.sha1(F.col("text").cast("binary")).alias("sha"), "doc_id")
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


def dedup_any_matched(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "jobs").where("id is not null").select("seq", "id", "title", "matched")
    return store.collapse(jobs, "seq").select("id", "title", "matched")


def last_write(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "run_log").select("seq", "company", "run_date", "status", "jobs_found")
    return store.last_by(log, "company", "seq")


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").where("url is not null").select("row_id", urls.canonical_url(F.col("url")).alias("canonical"))


def posting_ids(spark: SparkSession, sf: str) -> DataFrame:
    ident = posting_id(F.col("company"), F.when(F.col("ats") == "greenhouse", F.col("row_id").cast("string")), F.col("url"), F.col("title"), F.col("location"))
    return table(spark, sf, "postings").select("row_id", ident.alias("made_id"))


def host_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").groupBy(urls.normalize_host(F.coalesce("url", F.lit(""))).alias("host")).agg(F.count(F.lit(1)).alias("n_urls"))


def url_flags(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "companies").select("company_id", F.concat(F.coalesce("careers_url", F.lit("")), F.when(F.col("company_id") % 2 == 0, "Brochure.PDF?x=1").otherwise("jobs")).alias("url"))
    return df.select("company_id", urls.is_binary_url(F.col("url")).alias("is_binary"), urls.is_ats_api(F.col("url")).alias("is_api"), discovery.is_careers(F.col("url")).alias("is_careers"))


def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("https://", "ftp://", "https://user:pw@", "http://10.0.0.", "http://8.8.8.")]), (F.col("company_id") % 5 + 1).cast("int")), F.when(F.col("company_id") % 5 < 3, "a.example/").otherwise("8/x"))
    return table(spark, sf, "companies").select("company_id", urls.blocked_reason(made).alias("reason"))


def posting_url_flags(spark: SparkSession, sf: str) -> DataFrame:
    """What the addresses of all postings are."""
    df = table(spark, sf, "postings").where("url is not null")
    return df.select("row_id", urls.is_binary_url(F.col("url")).alias("is_binary"), urls.is_ats_api(F.col("url")).alias("is_api"), discovery.is_careers(F.col("url")).alias("is_careers"))


def posting_url_policy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").where("url is not null").select("row_id", urls.blocked_reason(F.col("url")).alias("reason"))


def posting_boards(spark: SparkSession, sf: str) -> DataFrame:
    """The board that each posting's address and description name, the address first."""
    found = F.coalesce(discovery.detect_ats(F.coalesce("url", F.lit(""))), discovery.detect_ats(F.coalesce("description", F.lit(""))))
    df = table(spark, sf, "postings").select("row_id", found.alias("f"))
    return df.select("row_id", F.col("f.ats").alias("ats"), F.col("f.token").alias("token"), F.col("f.host").alias("host"), F.col("f.site").alias("site"))


def health_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_alerts(table(spark, sf, "run_log"))


def error_streaks(spark: SparkSession, sf: str) -> DataFrame:
    return first_seen.error_streaks(table(spark, sf, "run_log"))


def run_states(spark: SparkSession, sf: str) -> DataFrame:
    return health.run_state(table(spark, sf, "run_log")).select("company", "streak", "last_status")


def company_facets(spark: SparkSession, sf: str) -> DataFrame:
    return browse.facets(table(spark, sf, "jobs"))


def meta_totals(spark: SparkSession, sf: str) -> DataFrame:
    return browse.totals(table(spark, sf, "jobs"), table(spark, sf, "run_log"))


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search(table(spark, sf, "jobs"), q="engineer", matched="1", offset=20, tie="seq")[1]


def search_count(spark: SparkSession, sf: str) -> DataFrame:
    return browse.search(table(spark, sf, "jobs"), q="data_%")[0]


def search_json(spark: SparkSession, sf: str) -> DataFrame:
    return browse.as_json(browse.search(table(spark, sf, "jobs"), company="Dektingirga Data Software", tie="seq")[1])


def ui_index(spark: SparkSession, sf: str) -> DataFrame:
    """Running numbers of the companies of the facet list."""
    from pyspark.sql import Window

    names = table(spark, sf, "companies").groupBy("tier", "name").agg(F.min("company_id").alias("company_id"))
    return names.select("tier", "name", F.lpad(F.row_number().over(Window.partitionBy("tier").orderBy("name")).cast("string"), 3, "0").alias("idx"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    batch = _batch(spark, sf)
    new = batch.where("id is not null").select("id").distinct().join(_state(spark, sf).select("id"), "id", "left_anti")
    return browse.run_summary(batch, new)


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").select("row_id", html.page_text("description").alias("text"))


def unescaped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "postings").select("row_id", text.html_unescape("description").alias("text"))


def page_change(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions of the later batches against those that earlier ones left for the same URL."""
    p = table(spark, sf, "postings").where("url is not null and url <> ''").select("row_id", "url", "description", "batch_no")
    old = store.last_by(p.where("batch_no <= 15").select("url", "row_id", F.sha1(F.col("description").cast("binary")).alias("body_sha1")), "url", "row_id")
    pages = p.where("batch_no > 15").select("row_id", "url", F.lit(200).alias("status_code"), F.col("description").alias("body"))
    return store.page_changes(pages, old).select("row_id", "outcome")


def live_cache(spark: SparkSession, sf: str) -> DataFrame:
    return store.live(table(spark, sf, "run_log").select("seq", "run_date"), "run_date", 30 * 86400, AS_OF).select("seq")


ROBOTS = "User-agent: *\n\nDisallow: /openings/1\nAllow: /openings/1*5$\nDisallow: /*?q=\nCrawl-delay: 2\nSitemap: https://x.example/s.xml\n\nUser-agent: otherbot\nDisallow: /\n"


def _robots(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "postings").where("url is not null and url <> ''").select(F.lower(urls.part(F.col("url"), "authority")).alias("host")).distinct()
    return hosts.select("host", F.lit(ROBOTS).alias("body"))


def robots_decision(spark: SparkSession, sf: str) -> DataFrame:
    return robots.decide(table(spark, sf, "postings").where("url is not null and url <> ''"), _robots(spark, sf), "loombot")


def request_interval(spark: SparkSession, sf: str) -> DataFrame:
    return robots.request_interval(_robots(spark, sf), "loombot")


def _board_text(df: DataFrame) -> DataFrame:
    base = F.when(F.col("ats") == "greenhouse", "see https://boards.greenhouse.io/embed/job_board?for=").when(F.col("ats") == "lever", "see https://jobs.lever.co/").when(F.col("ats") == "ashby", "see https://jobs.ashbyhq.com/")
    body = F.concat(base, F.coalesce("token", F.lit("embed")), F.lit('"> and https://jobs.lever.co/Extra<a href="https://jobs.lever.co/extra">'))
    return df.select("company_id", "name", F.when(F.col("ats") == "workday", F.concat(F.lit("https://x.wd5.myworkdayjobs.com/en-US/"), F.coalesce("token", F.lit("site")))).otherwise(F.coalesce(body, F.lit("no board"))).alias("body"))


def ats_detect(spark: SparkSession, sf: str) -> DataFrame:
    found = _board_text(table(spark, sf, "companies")).select("company_id", discovery.detect_ats(F.col("body")).alias("f"))
    return found.select("company_id", F.col("f.ats").alias("ats"), F.col("f.token").alias("token"), F.col("f.host").alias("host"), F.col("f.site").alias("site"))


def board_links(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.board_links(_board_text(table(spark, sf, "companies")), "company_id", "body")


def registry_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = _board_text(table(spark, sf, "companies")).select("company_id", discovery.entry(F.col("name"), discovery.detect_ats(F.col("body"))).alias("e"))
    return found.select("company_id", F.col("e.name").alias("name"), F.col("e.tier").alias("tier"), F.col("e.ats").alias("ats"), F.col("e.token").alias("token"))


def careers_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "postings").where("url is not null and url <> ''")
    return discovery.rank_careers(p.select(urls.normalize_host(F.col("url")).alias("site"), F.col("row_id").alias("pos"), "url"), "site")


def careers_default(spark: SparkSession, sf: str) -> DataFrame:
    sites = table(spark, sf, "companies").where("careers_url is not null").select("tier", F.col("company_id").alias("site"), F.regexp_replace("careers_url", "/+$", "").alias("root"))
    ranked = discovery.rank_careers(sites.where("tier = 0").select("site", F.lit(1).alias("pos"), F.concat("root", F.lit("/careers/all")).alias("url")), "site")
    return discovery.careers_or_default(sites, ranked, "site", "root")


def sitemap_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of sitemaps for each careers site: an index that names itself and a file of the site's postings."""
    site = urls.normalize_host(F.col("url"))
    p = table(spark, sf, "postings").where("url is not null and url <> '' and ats in ('html', 'spa')").select(site.alias("site"), "url").distinct()
    lists = p.groupBy("site", F.pmod(F.xxhash64("url"), F.lit(3)).alias("part")).agg(F.concat_ws("", F.array_sort(F.collect_set(F.concat(F.lit("<loc>"), "url", F.lit("</loc>"))))).alias("body"))
    files = lists.select(F.concat(F.lit("https://"), "site", F.lit("/s"), F.col("part").cast("string"), F.lit(".xml")).alias("url"), "body")
    roots = p.select("site").distinct()
    index = F.concat(F.lit("<sitemapindex>"), *[x for k in ("sitemap", "s0", "s1", "s2") for x in (F.lit("<loc>https://"), F.col("site"), F.lit(f"/{k}.xml</loc>"))])
    files = files.unionByName(roots.select(F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"), index.alias("body")))
    seeds = roots.select("site", F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("url"), F.lit(0).alias("pos"))
    return discovery.sitemap_pages(seeds, materialise(files, "sitemap-files")).select("site", "url", "level")


def candidate_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "postings").where("company is not null").select(F.col("company").alias("name"), "row_id")
    return discovery.dedup_candidates(found, table(spark, sf, "companies"), "row_id").select("name", "row_id")


def known_names(spark: SparkSession, sf: str) -> DataFrame:
    t = [table(spark, sf, "companies").select("name"), *[table(spark, sf, x).select(F.col("company").alias("name")) for x in ("jobs", "run_log")]]
    return discovery.known_names(*t)


def unresolved(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.without(table(spark, sf, "companies").select("name"), table(spark, sf, "jobs").select(F.col("company").alias("name")), "name")


def resolve_probe(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "run_log").select(F.col("company").alias("name"), F.col("seq").alias("rank"), F.lit("greenhouse").alias("ats"), text.norm_token(F.col("company")).alias("token"), "jobs_found")
    return discovery.resolve(log).select("name", "token", "rank", "jobs_found")


def approve_gate(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "jobs").groupBy(F.col("company").alias("name")).agg(F.count_if(F.col("matched") == 1).alias("jobs_found"))
    return discovery.approve(table(spark, sf, "companies").select("name"), counts).select("name", "approved", "error")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.evidence(table(spark, sf, "jobs"), "company", "seq")


def infer_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.struct(F.col("ats"), F.col("token"), F.when(F.col("ats") == "workday", "h.wd1.myworkdayjobs.com").alias("workday_host"), F.when(F.col("company_id") % 2 == 0, "site").alias("workday_site"), F.when(F.col("ats") == "html", "{}").alias("selectors"), F.col("careers_url").alias("xhr_url"))
    made = table(spark, sf, "companies").select("company_id", discovery.entry_from_verdict(F.col("name"), v).alias("e"))
    return made.select("company_id", F.col("e.tier").alias("tier"), F.col("e.ats").alias("ats"), F.coalesce("e.token", "e.host", "e.selectors", "e.url").alias("by"))


def json_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.dig(F.col("props"), "k").alias("k"), text.dig(F.col("props"), "a.b").alias("ab"))


#: What the registry says of boards without a schema of their own.
CONFIGS = {
    "spa": {"jobs_path": "data.list", "id": "key", "title": "a.t"},
    "html": {"job_item": "div.row", "title": "h3", "link": "a", "location": ".loc"},
}


def _listing_page() -> Column:
    escaped = lambda c: text.html_escape(F.coalesce(F.col(c), F.lit("")))
    return F.concat(F.lit('<div class="row"><a href="/j/'), F.col("row_id").cast("string"), F.lit('"><h3>'), escaped("title"), F.lit('</h3></a><span class="loc">'), escaped("location"), F.lit("</span></div>"))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """Each posting as the response of its board, one a body, with what the registry says of its kind."""
    p = table(spark, sf, "postings")
    full = {"ignoreNullFields": "false"}
    rid = F.col("row_id")
    gh = F.struct(F.array(F.struct(rid.alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"), F.col("url").alias("absolute_url"), text.html_escape(F.col("description")).alias("content"), F.col("posted_at").alias("updated_at"))).alias("jobs"))
    lv = F.array(F.struct(rid.cast("string").alias("id"), F.col("title").alias("text"), F.struct("location").alias("categories"), F.col("url").alias("hostedUrl"), F.col("description").alias("descriptionPlain"), (rid * 1000).alias("createdAt")))
    ab = F.struct(F.array(F.struct(rid.cast("string").alias("id"), "title", "location", F.col("url").alias("jobUrl"), F.col("description").alias("descriptionPlain"), F.col("posted_at").alias("publishedAt"))).alias("jobs"))
    wd = F.struct(F.lit(1).alias("total"), F.array(F.struct("title", F.col("location").alias("locationsText"), F.concat(F.lit("/job/"), rid.cast("string")).alias("externalPath"), F.col("posted_at").alias("postedOn"))).alias("jobPostings"))
    sp = F.struct(F.struct(F.array(F.struct(rid.alias("key"), F.struct(F.col("title").alias("t")).alias("a"), "location", "url")).alias("list")).alias("data"))
    body = F.when(F.col("ats") == "html", _listing_page())
    for kind, made in (("greenhouse", gh), ("lever", lv), ("ashby", ab), ("workday", wd), ("spa", sp)):
        body = body.when(F.col("ats") == kind, F.to_json(made, full))
    url = F.when(F.col("ats") == "html", F.concat(F.lit("https://c.example/list/"), rid.cast("string"))).when(F.col("ats") == "workday", "https://h.example/en-US/s")
    config = None
    for kind, c in CONFIGS.items():
        named = F.create_map(*[F.lit(x) for kv in c.items() for x in kv])
        config = F.when(F.col("ats") == kind, named) if config is None else config.when(F.col("ats") == kind, named)
    return p.select("row_id", F.coalesce("company", F.lit("")).alias("company"), "ats", url.alias("url"), F.when(F.col("ats") == "workday", 0).alias("offset"), body.alias("body"), config.alias("config"))


def source_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of all six kinds of boards as postings."""
    return landed.normalise_all(_landed(spark, sf))[0].select("id", "company", "title", "location", "url", "description", "posted_at", "source_tier")


def source_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Companies of kinds without a normaliser; here every tenth response is of such a kind."""
    kind = F.when(F.col("row_id") % 10 == 0, "paper").otherwise(F.col("ats"))
    return landed.normalise_all(_landed(spark, sf).withColumn("ats", kind))[1]


def spa_normalise(spark: SparkSession, sf: str) -> DataFrame:
    df = _landed(spark, sf).where("ats = 'spa'")
    return landed.spa(df, "data.list", {"id": "key", "title": "a.t"}).select("id", "company", "title", "location", "url", "source_tier")


def workday_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of companies as pages of 20 jobs, of which the first names the board's number of jobs and the others 0."""
    from pyspark.sql import Window

    j = table(spark, sf, "jobs").withColumn("n", F.row_number().over(Window.partitionBy("company").orderBy("seq")) - 1)
    item = F.struct("title", F.col("location").alias("locationsText"), F.concat(F.lit("/job/"), F.col("seq").cast("string")).alias("externalPath"), F.lit("Posted Today").alias("postedOn"))
    pages = j.groupBy("company", (F.floor(F.col("n") / 20) * 20).cast("int").alias("offset")).agg(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))).alias("l"))
    pages = pages.withColumn("total", F.sum(F.size("l")).over(Window.partitionBy("company")))
    body = F.to_json(F.struct(F.when(F.col("offset") == 0, F.col("total")).otherwise(0).alias("total"), F.transform("l", lambda x: x["i"]).alias("jobPostings")))
    out = landed.workday(pages.select("company", F.lit("https://h.example/en-US/s").alias("base_url"), "offset", body.alias("body")))
    return out.select("id", "company", "title", "location", "url", "posted_at")


def html_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Listing pages of a company in the order of their numbers; the first five jobs have detail pages."""
    p = table(spark, sf, "postings").where("ats = 'html' and company is not null")
    pages = p.select("company", F.concat(F.lit("https://c.example/list/"), F.col("row_id").cast("string")).alias("url"), _listing_page().alias("html"))
    found = html.listing(pages, CONFIGS["html"])
    found = found.withColumn("place", F.regexp_extract("url", r"(\d+)$", 1).cast("bigint") * 1000 + F.col("pos"))
    details = found.select("url", F.concat(F.lit("about "), "title").alias("text"))
    return landed.with_details(found, details, 5, "place").select("company", "url", "location", "description", "source_tier")


def digest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lines = _batch(spark, sf).where("matched = 1 and company is not null").select("company", "row_id", digest.job_line().alias("line"))
    return digest.pack(lines, "company", "row_id", "line")


def digest_whole(spark: SparkSession, sf: str) -> DataFrame:
    lines = _batch(spark, sf).where("matched = 1").select("row_id", digest.job_line().alias("line"))
    return digest.assemble("New & fine", digest.pack_whole(lines, "row_id", "line"), health.health_alerts(table(spark, sf, "run_log")).select("company", "message"))


def days_ago_bucket(spark: SparkSession, sf: str) -> DataFrame:
    label = dates.days_ago(F.col("o_orderdate").cast("timestamp"), datetime(1998, 8, 3, 12))
    return table(spark, sf, "orders").groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n_orders"))


def _arrivals_into(spark: SparkSession, sf: str, state: store.DeltaState) -> store.KeyedLog:
    """Arrivals streamed into a state; what was announced."""
    path = os.path.join(sf, "job_arrivals.parquet")
    schema = table(spark, sf, "job_arrivals").schema
    stream = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else os.path.join(sf, "job_arrivals*.parquet"))
    batch = stream.select("arrival_id", "id", "company", "title", "location", "url", F.lit("").alias("posted_at"), F.lit(1).alias("matched"))
    announced = store.KeyedLog(spark, scratch_path(spark, "stream-announced"), STATE, "id")
    query = first_seen.run_first_seen(batch, state, announced, scratch_path(spark, "stream-checkpoint"), "arrival_id", lambda epoch: f"2026-09-01T00:00:{epoch:02d}+00:00")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return announced


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The state that a stream of arrivals leaves where there was none."""
    state = store.DeltaState(spark, scratch_path(spark, "stream-state"), STATE)
    _arrivals_into(spark, sf, state)
    return state.read().select("id", "matched")


def stream_announced(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals announced by a stream into a state that holds the stored jobs."""
    state = store.DeltaState(spark, scratch_path(spark, "stream-state"), STATE)
    jobs = table(spark, sf, "jobs").select("seq", "id", "company", "title", "location", "url", "posted_at", "matched")
    state.merge(jobs, "seq", "2026-08-31T00:00:00+00:00", "stored")
    return _arrivals_into(spark, sf, state).read().select("id", "company", "title")


def seed_mode(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch finds new, and what it announces, where there is no state and where there is one."""
    batch = _batch(spark, sf)
    empty = store.merge(spark.createDataFrame([], STATE), batch, "row_id", "2026-09-01T00:00:00+00:00")
    later = store.merge(_state(spark, sf), batch, "row_id", "2026-09-01T00:00:00+00:00")
    counted = [r.new.agg(F.count(F.lit(1)).alias("n_new")).crossJoin(r.fresh.agg(F.count(F.lit(1)).alias("n_announced"))).select(F.lit(r.seed).alias("seed"), "n_new", "n_announced") for r in (empty, later)]  # one row each
    return counted[0].unionByName(counted[1])


def stream_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Error streaks kept from a stream of the run log; companies without a current error have 0."""
    path = os.path.join(sf, "run_log.parquet")
    stream = spark.readStream.schema(table(spark, sf, "run_log").schema).parquet(path if os.path.isdir(path) else os.path.join(sf, "run_log*.parquet"))
    state = store.KeyedLog(spark, scratch_path(spark, "streaks"), first_seen.STREAKS, "company")
    query = first_seen.run_streaks(stream.select("company", "seq", "status"), state, scratch_path(spark, "streaks-checkpoint"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return state.read().select("company", "streak", "last_seq")


def candidate_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of three sources in their order of priority; names of the registry are known."""
    named = lambda t, c, pos, url: table(spark, sf, t).where(f"{c} is not null").select(F.col(c).alias("name"), url.alias("url"), F.col(pos).alias("pos"))
    found = discovery.gather(named("job_arrivals", "company", "arrival_id", F.lit("")), named("documents", "company", "doc_id", F.lit("")), named("postings", "company", "row_id", F.col("url")))
    ordered = found.withColumn("place", F.col("source_rank") * (1 << 40) + F.col("pos"))
    return discovery.dedup_candidates(ordered, table(spark, sf, "companies"), "place").select("name", "source_rank", "pos")


def discovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "postings").where("company is not null").select(F.col("company").alias("name"), "row_id")
    return discovery.summary(found, discovery.dedup_candidates(found, table(spark, sf, "companies"), "row_id"))


def page_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The page cache after the later batches, of which only rows with a title could be parsed."""
    p = table(spark, sf, "postings").where("url is not null and url <> ''").select("row_id", "url", "title", "description", "batch_no")
    hashed = F.sha1(F.col("description").cast("binary"))
    old = store.last_by(p.where("batch_no <= 15").select("url", "row_id", hashed.alias("body_sha1")), "url", "row_id").select("url", "body_sha1")
    new = store.last_by(p.where("batch_no > 15").select("url", "row_id", "title", "description"), "url", "row_id")
    pages = store.page_changes(new.select("url", F.lit(200).alias("status_code"), F.col("description").alias("body")), old)
    return store.commit_pages(old, pages, new.where("title is not null").select("url"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("row_id") % 7 == 0, 304).when(F.col("row_id") % 11 == 0, 403).otherwise(200)
    responses = _landed(spark, sf).withColumn("status_code", code)
    return landed.outcomes(responses, landed.normalise_all(responses.where("status_code = 200"))[0])


def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What a run over the landed responses would log for each company."""
    return _outcomes(spark, sf).select("company", "status", "jobs_found")


def log_append(spark: SparkSession, sf: str) -> DataFrame:
    """The run log with the rows of that run behind its own."""
    log = table(spark, sf, "run_log").select("seq", "run_date", "company", "status", "jobs_found", F.coalesce("error", F.lit("")).alias("error"))
    return log.unionByName(store.log_run(log, _outcomes(spark, sf), "2026-09-01T00:00:00+00:00"))


def request_gate(spark: SparkSession, sf: str) -> DataFrame:
    """What a request of each posting's address would meet; hosts have one of three robots files, by the length of their name."""
    urls_ = table(spark, sf, "postings").where("url is not null").select("url").unionByName(_made_urls(spark, sf).select("url"))
    hosts = urls_.where("url <> ''").select(F.lower(urls.part(F.col("url"), "authority")).alias("host")).distinct()
    which = F.length("host") % 3
    files = hosts.select("host", F.when(which == 0, ROBOTS).when(which == 1, "User-agent: loombot\nDisallow: /\nAllow: /jobs\n\nUser-agent: *\nCrawl-delay: 9\n").otherwise("").alias("body"))
    return robots.gate(urls_, files, "loombot")


def _made_urls(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("company_id").cast("string")
    made = F.element_at(F.array(F.concat(F.lit("ftp://a.example/"), n), F.concat(F.lit("https://user:pw@a.example/"), n), F.concat(F.lit("http://10.0.0.8/"), n), F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), n)), (F.col("company_id") % 4 + 1).cast("int"))
    return table(spark, sf, "companies").select("company_id", made.alias("url"))


def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The board of each company: by its address, its page, a careers page or its name, as the company's number has it."""
    c = table(spark, sf, "companies").select("company_id", "name", F.col("company_id").cast("string").alias("n"), F.pmod("company_id", F.lit(5)).alias("k"))
    url = F.when(F.col("k") == 0, F.concat(F.lit("https://jobs.lever.co/t"), "n")).when(F.col("k") < 4, F.concat(F.lit("https://c"), "n", F.lit(".example/")))
    candidates = c.select("name", url.alias("url"))
    page = lambda k, at, body: c.where(F.col("k") == k).select(F.concat(F.lit("https://c"), "n", F.lit(at)).alias("url"), F.concat(F.lit(body), "n", F.lit('"')).alias("body"))
    pages = page(1, ".example/", 'see "https://jobs.ashbyhq.com/t').unionByName(page(2, ".example/", 'nothing here "')).unionByName(page(2, ".example/careers", 'src="https://boards.greenhouse.io/embed/job_board?for=t'))
    careers = c.where("k = 2").select("name", F.posexplode(F.array(*[F.concat(F.lit("https://c"), "n", F.lit(p)) for p in (".example/jobs", ".example/careers")])).alias("p", "url")).select("name", (F.col("p") + 1).alias("rank"), "url")
    known = c.select(F.explode(F.array(F.struct(F.lit("lever").alias("ats"), F.concat(F.lit("t"), "n").alias("token"), F.lit(2).alias("jobs_found")), F.struct(F.lit("ashby").alias("ats"), F.concat(F.lit("t"), "n").alias("token"), F.lit(3).alias("jobs_found")), F.struct(F.lit("greenhouse").alias("ats"), F.concat(F.lit("t"), "n").alias("token"), (F.col("company_id").cast("int") % 2).alias("jobs_found")), F.struct(F.lit("greenhouse").alias("ats"), text.norm_token(F.col("name")).alias("token"), F.lit(0).alias("jobs_found")), F.struct(F.lit("ashby").alias("ats"), text.norm_token(F.col("name")).alias("token"), F.lit(7).alias("jobs_found")))).alias("p")).select("p.*")
    none = F.lit(None).cast("string")
    return discovery.cascade(candidates, pages, careers, known.withColumns({"host": none, "site": none})).select("name", "via", "rank", "ats", "token", "jobs_found")


def _notes() -> Column:
    return F.struct(F.col("ats"), F.when(F.col("company_id") % 2 == 0, F.col("token")).alias("token"), F.lit(None).cast("string").alias("workday_host"), F.lit(None).cast("string").alias("workday_site"), F.lit(None).cast("string").alias("selectors"), F.lit(None).cast("string").alias("xhr_url"), F.repeat(F.concat("name", F.lit("; ")), 30).alias("notes"))


def infer_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of the verdicts that make an entry, and the note of those that don't."""
    made = table(spark, sf, "companies").withColumn("v", _notes()).select("company_id", discovery.verdict_outcome(discovery.entry_from_verdict(F.col("name"), F.col("v")), F.col("v")).alias("o"))
    return made.select("company_id", "o.evidence", "o.llm")


def infer_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The next ten candidates without a verdict."""
    c = table(spark, sf, "companies").select("name", F.coalesce("careers_url", F.lit("")).alias("url"), F.when(F.col("token").isNull(), "no board").alias("llm"), F.col("company_id").alias("pos"))
    return discovery.infer_queue(c, 10).select("name", "url", "pos")


def infer_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The queue's candidates with as much of their page as a model is shown; here a page repeats the candidate's name."""
    c = table(spark, sf, "companies")
    queue = discovery.infer_queue(c.select("name", F.coalesce("careers_url", F.lit("")).alias("url"), F.lit(None).cast("string").alias("llm"), F.col("company_id").alias("pos")), 20)
    pages = c.where("careers_url is not null").select(F.col("careers_url").alias("url"), F.repeat(F.concat("careers_url", F.lit(" ")), 2000).alias("body")).distinct()
    return discovery.infer_pages(queue, pages).select("name", "page")


def jsearch_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Employers of landed search results, one response for each company of the run log."""
    item = F.struct(F.col("company").alias("employer_name"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("https://e.example/"), F.col("seq").cast("string"))).alias("employer_website"))
    bodies = table(spark, sf, "run_log").select(F.to_json(F.struct(F.array(item, F.struct(F.lit("").alias("employer_name"), F.lit(None).cast("string").alias("employer_website"))).alias("data"))).alias("body"))
    return landed.jsearch(bodies)


def jsearch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return landed.search_plan(spark, FILTERS.roles, FILTERS.locations)


def registry_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Postings whose company and kind would make a registry entry that can be run, by kind."""
    return table(spark, sf, "postings").where(config.valid_entry(F.col("company"), F.col("ats"))).groupBy("ats").agg(F.count(F.lit(1)).alias("n"))


def board_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a token file made of the registry: a comment and an empty line before each."""
    lines = table(spark, sf, "companies").select(F.explode(F.array(F.concat(F.lit("# "), "name"), F.lit("  "), F.concat(F.lit(" "), F.coalesce("token", F.lit("")), F.lit(" ")))).alias("value"))
    return discovery.token_lines(lines)


def sitemap_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Where the sitemaps of the hosts of all postings are looked for; the hosts with names of even length have a robots file."""
    files = _robots(spark, sf)
    sites = files.select(F.col("host").alias("site"), "host", F.concat(F.lit("https://"), "host", F.lit("/")).alias("root"))
    return discovery.sitemap_seeds(sites, robots.rule_lines(files.where(F.length("host") % 2 == 0), "loombot"))


def sitemap_zipped(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of compressed sitemaps, one for each posting with an address, that are read and inflated."""
    p = table(spark, sf, "postings").where("url is not null and url <> '' and url not rlike '[<\\\\s]'").select("row_id", "url")
    files = p.select(F.concat(F.lit("https://s.example/"), F.col("row_id").cast("string"), F.lit(".xml.GZ")).alias("url"), sitemaps.deflate(F.concat(F.lit("<urlset><loc>"), "url", F.lit("</loc></urlset>"))).alias("content"))
    return sitemaps.bodies(files).select(F.explode(F.regexp_extract_all("body", F.lit(discovery.LOC), 1)).alias("url"))


def api_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return browse.jobs_object(table(spark, sf, "jobs"), q="engineer", matched="1", offset=20, tie="seq")


def api_meta(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "run_log")
    return browse.meta_object(table(spark, sf, "jobs"), log, health.health_alerts(log))


def page_main(spark: SparkSession, sf: str) -> DataFrame:
    """Text of pages with chrome around a main part, made of each posting's title and company."""
    part_ = lambda c: text.html_escape(F.coalesce(F.col(c), F.lit("")))
    page = F.concat(F.lit("<html><header>Logo</header><nav><a href='/'>Home</a></nav><p>outside</p><main><h1>"), part_("title"), F.lit("</h1><div class='share big'>Share<p>it</p></div><script>x()</script><p>by "), part_("company"), F.lit("</p></main><footer>(c)</footer></html>"))
    return table(spark, sf, "postings").select("row_id", html.page_text(page).alias("text"))


def unescape_back(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions escaped and read again."""
    return table(spark, sf, "postings").select("row_id", text.html_unescape(text.html_escape(F.col("description"))).alias("text"))


def summary_input(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty lines that a digest's summary is written from."""
    return digest.summary_lines(_batch(spark, sf).where("matched = 1").select("row_id", digest.job_line().alias("line")), "row_id", "line")


def postings_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Postings cast to the record's schema, nulls as empty strings."""
    names = [c.split()[0] for c in POSTING.split(", ")]
    df = table(spark, sf, "postings")
    cast = [F.coalesce(F.col(c), F.lit("")).alias(c) if c != "source_tier" else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    return df.select("row_id", *cast).groupBy("source_tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.substring("description", 1, 8000))).alias("n_chars"))


def queries() -> dict:
    names = """match_postings experience_filter posted_recency full_match first_seen_new merge_state merge_new dedup_first dedup_any_matched last_write canonical_urls posting_ids host_rollup url_flags url_policy
        health_alerts error_streaks run_states company_facets meta_totals search_page search_count search_json ui_index run_summary page_text unescaped page_change live_cache robots_decision request_interval ats_detect
        board_links registry_entries careers_rank careers_default sitemap_bfs candidate_dedup known_names unresolved resolve_probe approve_gate evidence infer_verdicts json_paths source_normalise source_skipped spa_normalise
        workday_pages html_listing digest_chunks digest_whole days_ago_bucket stream_first_seen stream_announced seed_mode stream_streaks candidate_sources discovery_summary page_commit run_outcomes postings_schema log_append request_gate resolve_cascade
        infer_notes infer_pages posting_url_flags posting_url_policy posting_boards infer_queue jsearch_candidates jsearch_plan registry_valid board_tokens sitemap_seeds sitemap_zipped api_jobs api_meta page_main unescape_back summary_input"""
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    from hireloom.plans.core_sql import SQL

    return SQL
