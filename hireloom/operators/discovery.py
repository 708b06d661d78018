"""Discovery: board detection, candidates, careers pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hireloom.common import materialise
from hireloom.functions.text import norm_token
from hireloom.functions.urls import part

# Addresses of applicant-tracking boards, words that stand where a token would, words of careers paths.
WORKDAY = r"https?://([a-z0-9-]+\.wd\d+\.myworkdayjobs\.com)/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"
BOARDS = (
    ("greenhouse", r"boards\.greenhouse\.io/(?:embed/job_board\?for=)?([A-Za-z0-9_-]+)", "https://boards.greenhouse.io/"),
    ("lever", r"jobs\.(?:eu\.)?lever\.co/([A-Za-z0-9_-]+)", "https://jobs.lever.co/"),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)", "https://jobs.ashbyhq.com/"),
)
NOT_TOKENS = ("embed", "job_board", "jobs", "js", "css", "img")
CAREERS = r"(?i)career|/jobs?\b|job-openings|joinus|join-us|work-with-us|opening|vacanc|opportunit"
LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"
FALLBACK_PATHS = ("/careers", "/careers/", "/jobs")


def _tokens(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), 1), lambda t: ~F.lower(t).isin(*NOT_TOKENS))


def detect_ats(text: Column) -> Column:
    """struct(ats, token, host, site) of the first board that a text or URL names; null where it names none."""
    kind = "struct<ats:string,token:string,host:string,site:string>"
    nothing = F.lit(None).cast("string")
    workday = F.when(text.rlike(WORKDAY), F.struct(F.lit("workday").alias("ats"), nothing.alias("token"), F.regexp_extract(text, WORKDAY, 1).alias("host"), F.regexp_extract(text, WORKDAY, 2).alias("site")).cast(kind))
    found = [workday]
    for ats, pattern, _ in BOARDS:
        tokens = _tokens(text, pattern)
        found.append(F.when(F.size(tokens) > 0, F.struct(F.lit(ats).alias("ats"), F.get(tokens, F.lit(0)).alias("token"), nothing.alias("host"), nothing.alias("site")).cast(kind)))
    return F.coalesce(*found)


def board_links(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name, url): distinct boards a page links, by board and place; a token counts once whatever its case."""
    ranked = [
        pages.select(key, F.lit(rank).alias("rank"), F.lit(base).alias("base"), F.posexplode(_tokens(F.col(text), pattern)).alias("pos", "name"))
        for rank, (_, pattern, base) in enumerate(BOARDS)
    ]
    found = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    first = found.groupBy(key, F.lower("name").alias("_k")).agg(F.min(F.struct("rank", "pos", "name", "base")).alias("f"))
    order = Window.partitionBy(key).orderBy("f.rank", "f.pos")
    return first.select(key, F.row_number().over(order).alias("pos"), F.col("f.name").alias("name"), F.concat("f.base", "f.name").alias("url"))


def dedup_candidates(found: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Candidates (name, ..., order) whose normalised name isn't known; the first of each name."""
    keyed = found.withColumn("_key", norm_token(F.col("name"))).where(F.col("_key") != "")
    fresh = keyed.join(known.select(norm_token(F.col("name")).alias("_key")).distinct(), "_key", "left_anti")
    return fresh.groupBy("_key").agg(F.min_by(F.struct(*found.columns), order).alias("_row")).select("_row.*")


def known_names(*tables: DataFrame) -> DataFrame:
    """Distinct non-empty names of several tables."""
    out = tables[0].select("name")
    for t in tables[1:]:
        out = out.union(t.select("name"))
    return out.where("name <> ''").distinct()


def without(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key wasn't taken: candidates after resolving, pending ones after approval."""
    return rows.join(taken.select(key).distinct(), key, "left_anti")


def token_lines(lines: DataFrame) -> DataFrame:
    """Names of a token file's lines (value), without blanks and comments."""
    return lines.select(F.trim("value").alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))


def is_careers(url: Column) -> Column:
    return part(url, "path").rlike(CAREERS)


def rank_careers(urls: DataFrame, site: str, limit: int = 5) -> DataFrame:
    """(site, rank, url) from (site, pos, url): careers pages of each site, shallow before deep, short before long, then by pos.

    URLs that differ in slashes at their end count once. Each task ranks before the shuffle, so a large site isn't gathered.
    """
    hits = urls.where(is_careers(F.col("url")))
    depth = F.length(F.regexp_replace(F.regexp_replace(part(F.col("url"), "path"), "^/+|/+$", ""), "[^/]", ""))
    order = F.struct(depth.alias("depth"), F.length("url").alias("size"), "pos")
    first = hits.groupBy(site, F.regexp_replace("url", "/+$", "").alias("_k")).agg(F.min(F.struct(order.alias("o"), "url")).alias("f"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(site).orderBy("f.o"))).where(F.col("rank") <= limit)
    return ranked.select(site, "rank", F.col("f.url").alias("url"))


def careers_or_default(sites: DataFrame, ranked: DataFrame, site: str, root: str) -> DataFrame:
    """(site, rank, url): the ranked pages, or the usual paths for sites without any."""
    usual = sites.join(ranked.select(site).distinct(), site, "left_anti").select(site, F.posexplode(F.array(*[F.concat(F.col(root), F.lit(p)) for p in FALLBACK_PATHS])).alias("pos", "url"))
    return ranked.unionByName(usual.select(site, (F.col("pos") + 1).alias("rank"), "url"))


def sitemap_seeds(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, url, pos) where the search of a site's sitemaps begins, from sites (site, host, root) and the lines of their robots files
    (host, seq, field, value): the sitemaps these name, in their order, then the usual place; each once, at its first place."""
    named = rules.where(F.col("field") == "sitemap").join(sites.select("site", "host"), "host").select("site", F.col("value").alias("url"), F.col("seq").cast("bigint").alias("at"))
    usual = sites.select("site", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/sitemap.xml")).alias("url"), F.lit(1 << 40).alias("at"))
    first = named.unionByName(usual).where("url <> ''").groupBy("site", "url").agg(F.min("at").alias("at"))
    order = Window.partitionBy("site").orderBy("at", "url")  # as many as a robots file of bounded size names
    return first.select("site", "url", (F.row_number().over(order) - 1).alias("pos"))


def sitemap_pages(seeds: DataFrame, files: DataFrame, max_files: int = 10, max_urls: int = 20_000) -> DataFrame:
    """(site, url, level, pos) of the pages that each site's sitemaps list, from seeds (site, url, pos) and files (url, body).

    Breadth first with one join a level over all sites; a file counts once for each site, at most ``max_files`` of a site are
    opened, missing ones included, and ``max_urls`` pages of a site kept.
    """
    todo = seeds.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    seen = pages = None
    for level in range(max_files):
        if seen is not None:
            todo = todo.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        used = todo if seen is None else todo.join(seen.groupBy("site").agg(F.count(F.lit(1)).alias("used")), "site", "left")
        if seen is None:
            used = used.withColumn("used", F.lit(0))
        rank = F.row_number().over(Window.partitionBy("site").orderBy("pos", "url"))
        opened = used.withColumn("rank", rank + F.coalesce("used", F.lit(0))).where(F.col("rank") <= max_files).select("site", "url", "rank")
        opened = materialise(opened, "sitemap-level")
        if opened.isEmpty():
            break
        seen = opened if seen is None else seen.unionByName(opened)
        bodies = opened.join(files, "url").select("site", "rank", F.col("body").rlike("(?i)<sitemapindex").alias("index"), F.posexplode(F.regexp_extract_all("body", F.lit(LOC), 1)).alias("p", "loc"))
        bodies = materialise(bodies, "sitemap-locs")
        place = F.col("rank").cast("bigint") * 1_000_000 + F.col("p")
        listed = bodies.where("not index").select("site", F.col("loc").alias("url"), F.lit(level).alias("level"), place.alias("pos"))
        pages = listed if pages is None else pages.unionByName(listed)
        todo = bodies.where("index").groupBy("site", F.col("loc").alias("url")).agg(F.min(place).alias("pos"))
    if pages is None:
        return seeds.sparkSession.createDataFrame([], "site string, url string, level int, pos bigint")
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("_n") <= max_urls).drop("_n")


def board_key(ats: Column, token: Column, host: Column, site: Column) -> Column:
    """By what a probe of a board is found again."""
    return F.concat_ws("|", ats, F.coalesce(token, F.concat_ws("/", host, site)))


def cascade(candidates: DataFrame, pages: DataFrame, careers: DataFrame, probes: DataFrame, most_careers: int = 3) -> DataFrame:
    """(name, via, rank, ats, token, host, site, jobs_found): the board of each candidate (name unique, url) that has one with postings.

    The URL itself is looked at first, then its landed page (``pages``: url, body), then the site's first careers pages (``careers``:
    name, rank, url), their URLs before their bodies. Only where all of them name no board, the name is tried as a token of each
    kind of board in turn. A try counts when its probe (ats, token, host, site, jobs_found) found a posting.
    """
    body = pages.groupBy("url").agg(F.first("body", ignorenulls=True).alias("body"))
    first = candidates.select("name", "url").join(body, "url", "left").select("name", F.coalesce("url", F.lit("")).alias("url"), "body")
    near = careers.where(F.col("rank") <= most_careers).select("name", "rank", "url").join(body, "url", "left")
    near = near.withColumn("hit", F.coalesce(detect_ats(F.col("url")), detect_ats(F.col("body")))).where("hit is not null")
    near = near.groupBy("name").agg(F.min_by("hit", "rank").alias("_near"))
    hits = first.join(near, "name", "left").withColumn("_url", detect_ats(F.col("url"))).withColumn("_page", F.when(F.col("url") != "", detect_ats(F.col("body"))))
    hit = F.coalesce("_url", "_page", F.when(F.col("url") != "", F.col("_near")))
    via = F.when(F.col("_url").isNotNull(), "url").when(F.col("_page").isNotNull(), "page").otherwise("careers")
    none = F.lit(None).cast("string")
    guess = lambda ats: F.struct(F.lit(ats).alias("ats"), norm_token(F.col("name")).alias("token"), none.alias("host"), none.alias("site"))
    tries = F.when(hit.isNotNull(), F.array(hit)).otherwise(F.array(*[guess(ats) for ats, _, _ in BOARDS]))
    asked = hits.select("name", F.when(hit.isNotNull(), via).otherwise("name").alias("via"), F.posexplode(tries).alias("rank", "t")).select("name", "via", "rank", "t.*")
    key = board_key(F.col("ats"), F.col("token"), F.col("host"), F.col("site"))
    live = probes.where("jobs_found > 0").groupBy(key.alias("_k")).agg(F.max("jobs_found").alias("jobs_found"))
    found = asked.withColumn("_k", key).join(live, "_k").drop("_k")
    best = found.groupBy("name").agg(F.min_by(F.struct("via", "rank", "ats", "token", "host", "site", "jobs_found"), "rank").alias("_r"))
    return best.select("name", "_r.*")


def resolve(probes: DataFrame) -> DataFrame:
    """(name, rank, ats, token, jobs_found) -> the first probe of each candidate that found a posting."""
    return probes.where("jobs_found > 0").groupBy("name").agg(F.min_by(F.struct("ats", "token", "jobs_found", "rank"), "rank").alias("_r")).select("name", "_r.*")


def approve(pending: DataFrame, counts: DataFrame) -> DataFrame:
    """Pending entries with ``approved`` and ``error``: an entry needs one live posting."""
    joined = pending.join(counts.select("name", "jobs_found"), "name", "left")
    good = F.coalesce("jobs_found", F.lit(0)) > 0
    return joined.withColumn("approved", good).withColumn("error", F.when(~good, "no postings found"))


def evidence(jobs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, evidence): how many postings are live and the first three titles, without gathering the others."""
    first = jobs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= 3)
    titles = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]), "; ").alias("_t"))
    counts = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return counts.join(titles, key).select(key, F.concat(F.col("_c").cast("string"), F.lit(" jobs live; sample: "), "_t").alias("evidence"))


def entry(name: Column, found: Column) -> Column:
    """Registry entry of a detected board."""
    return F.when(found.isNotNull(), F.struct(name.alias("name"), F.lit(0).alias("tier"), found["ats"].alias("ats"), found["token"].alias("token"), found["host"].alias("host"), found["site"].alias("site")))


def entry_from_verdict(name: Column, v: Column) -> Column:
    """Registry entry of a landed verdict, null where what its kind needs is missing."""
    blank = F.lit(None).cast("string")
    make = lambda tier, **kw: F.struct(name.alias("name"), F.lit(tier).alias("tier"), v["ats"].alias("ats"), *[kw.get(k, blank).alias(k) for k in ("token", "host", "site", "selectors", "url")])
    return (
        F.when(v["ats"].isin("greenhouse", "lever", "ashby") & (F.coalesce(v["token"], F.lit("")) != ""), make(0, token=v["token"]))
        .when((v["ats"] == "workday") & v["workday_host"].isNotNull() & v["workday_site"].isNotNull(), make(0, host=v["workday_host"], site=v["workday_site"]))
        .when((v["ats"] == "html") & v["selectors"].isNotNull(), make(1, selectors=v["selectors"]))
        .when((v["ats"] == "spa") & v["xhr_url"].isNotNull(), make(2, url=v["xhr_url"]))
    )


def verdict_outcome(found: Column, v: Column) -> Column:
    """struct(evidence, llm) of a landed verdict: with an entry, evidence for a reviewer; without one, the note that ends its turn."""
    notes = F.coalesce(v["notes"], F.lit(""))
    evidence = F.when(found.isNotNull(), F.concat(F.lit("LLM: "), F.substring(notes, 1, 300)))
    note = F.when(found.isNull(), F.concat(F.coalesce(v["ats"], F.lit("None")), F.lit(": "), F.substring(notes, 1, 200)))
    return F.struct(evidence.alias("evidence"), note.alias("llm"))


def infer_queue(candidates: DataFrame, limit: int) -> DataFrame:
    """The next candidates (name, url, llm, pos) without a verdict yet."""
    return candidates.where("llm is null").orderBy("pos").limit(limit)


#: Characters of a page that a model is shown.
PAGE_LIMIT = 40_000


def infer_pages(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, url, pos, page): each candidate of the queue with the beginning of its landed page (url, body), null where none landed."""
    beginnings = pages.groupBy("url").agg(F.min(F.substring("body", 1, PAGE_LIMIT)).alias("page"))
    return queue.select("name", "url", "pos").join(beginnings, "url", "left")


def gather(*sources: DataFrame) -> DataFrame:
    """(name, url, source_rank, pos) of candidate sources (name, url, pos), the first source first; their order decides who is kept."""
    out = None
    for rank, s in enumerate(sources):
        part_ = s.select("name", F.coalesce("url", F.lit("")).alias("url"), F.lit(rank).alias("source_rank"), F.col("pos").cast("bigint").alias("pos"))
        out = part_ if out is None else out.unionByName(part_)
    return out


def summary(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: how many candidates were found, are new, and were known or double."""
    counts = found.agg(F.count(F.lit(1)).alias("found")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("fresh")))  # one row each
    return counts.withColumn("dropped", F.col("found") - F.col("fresh"))
