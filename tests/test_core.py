from datetime import datetime

from pyspark.sql import functions as F

from hireloom.functions import dates, match, text, urls
from hireloom.functions.ids import posting_id
from hireloom.operators import digest, discovery, health, robots, store
from hireloom.plans import core_queries
from hireloom.schema import RUN_LOG, STATE
from hireloom.sources import html, landed
from hireloom.sources import sitemaps as sm

NOW = datetime(2026, 7, 10, 12)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def table_of(spark, rows, schema, expr):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expr.alias("x")).collect()]


def test_roles_and_locations(spark):
    f = match.Filters(("Backend Engineer", "ML Engineer"), ("Oslo", "Pune"), True)
    rows = [
        ("Senior Backend Engineer", "Oslo", True), ("Backend Platform Engineer", "Oslo", True), ("Backend of the Big Engineer", "Oslo", False), ("Engineer, Backend", "Oslo", False),
        ("Machine Learning Engineer", "Pune, India", True), ("Frontend Engineer", "Oslo", False), ("Backend Engineer", "Remote", True), ("Backend Engineer", " remote ", True),
        ("Backend Engineer", "Remote - US", False), ("Backend Engineer", "Osloborg", False), ("Backend Engineer", None, False), (None, "Oslo", False), ("BACKEND ENGINEER", "oslo", True), ("Backend Engineering", "Oslo", False),
    ]
    expr = match.title_ok(F.col("t"), f.roles) & match.location_ok(F.col("l"), f.locations, True)
    assert table_of(spark, [r[:2] for r in rows], "t string, l string", expr) == [r[2] for r in rows]


def test_experience(spark):
    rows = [
        ("Engineer", "", True), ("Senior Engineer", "", False), ("Junior Engineer", "needs 8 years", True), ("Engineer III", "", False), ("Engineer II", "", True), ("SDE L5", "", False), ("Engineer (1-3 years)", "", True),
        ("Engineer", "3+ years", False), ("Engineer", "2 years", True), ("Engineer", "founded 12 years ago", True), ("Engineer", "0 to 2 years", True), (None, None, True), ("Sr. Engineer", "", False), ("New grad, senior", "", True),
    ]
    assert table_of(spark, [r[:2] for r in rows], "t string, d string", match.experience_ok(F.col("t"), F.col("d"), 2)) == [r[2] for r in rows]
    assert match.max_years("0-2 years") == 2 and match.max_years("") is None


def test_recency(spark):
    rows = [("2026-07-09T00:00:00Z", True), ("2026-07-02T13:00:00-04:00", True), ("2026-06-01", False), ("Posted 3 Days Ago", True), ("Posted 30+ Days Ago", False), ("Posted Today", True), ("", True), (None, True), ("soon", True), ("1783684800000", True), ("99999999999999999999", True), ("2027-01-01", True)]
    assert table_of(spark, [r[:1] for r in rows], "p string", dates.posted_recently(F.col("p"), 7, NOW)) == [r[1] for r in rows]
    assert table_of(spark, [("2026-07-10 11:00:00",), ("2026-07-09 11:00:00",), ("2026-07-01 00:00:00",)], "t string", dates.days_ago(F.col("t").cast("timestamp"), NOW)) == ["today", "yesterday", "9d ago"]


def test_urls_and_ids(spark):
    rows = [("HTTPS://Jobs.Example/A?utm_x=1&b=2&gh_jid=3#f", "https://jobs.example/A?b=2"), ("https://x.example", "https://x.example"), ("https://x.example/a b|c?q", "https://x.example/a b|c?q"), ("/rel?utm_a=1", "/rel"), (None, None)]
    assert table_of(spark, [r[:1] for r in rows], "u string", urls.canonical_url(F.col("u"))) == [r[1] for r in rows]
    assert one(spark, urls.canonical_url(F.col("u"), ("gh_jid",)), u="https://x.example/?gh_jid=3&gh_src=4") == "https://x.example/?gh_jid=3"
    assert table_of(spark, [("https://www.X.example:80/a",), ("https://u:p@x.example",), ("nothing",)], "u string", urls.normalize_host(F.col("u"))) == ["x.example", "x.example", ""]
    assert table_of(spark, [("https://x.example/a.PDF?x",), ("https://x.example/a?b=.pdf",)], "u string", urls.is_binary_url(F.col("u"))) == [True, False]
    assert table_of(spark, [("ftp://x.example",), ("https://a:b@x.example",), ("https:///p",), ("http://127.0.0.1/",), ("http://[::1]/",), ("https://8.8.8.8/",), ("https://x.example/",)], "u string", urls.blocked_reason(F.col("u"))) == ["scheme", "credentials", "host", "private", "private", None, None]
    made = [posting_id(*[F.lit(x) for x in row]) for row in (("c", "1", "u", "t", "l"), ("c", "", "HTTPS://x.example/?utm_a=1", "t", "l"), ("c", None, "", "t", "l"))]
    import hashlib

    assert [one(spark, m) for m in made] == [hashlib.sha1(x.encode()).hexdigest() for x in ("c:1", "https://x.example/", "c|t|l")]


def test_text_functions(spark):
    assert one(spark, text.html_escape(F.col("a")), a="<a & 'b' \"c\">") == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    assert one(spark, text.html_unescape(F.col("a")), a="&lt;p&gt;&eacute;&amp;") == "<p>é&"
    assert one(spark, text.contains_like(F.col("a"), "x\\y"), a="aX\\Yb") is True
    assert one(spark, text.dig(F.col("a"), "b.c"), a='{"b": {"c": 3}}') == "3" and one(spark, text.dig(F.col("a"), "b.x"), a='{"b": null}') == ""


def test_merge(spark):
    state = spark.createDataFrame([], STATE)
    cols = "n int, id string, company string, title string, location string, url string, posted_at string, matched int"
    row = lambda n, i, m, t="t": (n, i, "c", t, "l", "u", "p", m)
    first = store.merge(state, spark.createDataFrame([row(1, "1", 1), row(2, "2", 0), row(3, None, 1)], cols), "n", "day1")
    assert first.seed and first.fresh.count() == 0 and first.new.count() == 2
    second = store.merge(first.state, spark.createDataFrame([row(1, "1", 0), row(2, "2", 0), row(3, "3", 0, "first"), row(4, "3", 1, "second")], cols), "n", "day2")
    assert [(r["id"], r["title"], r["matched"]) for r in second.fresh.collect()] == [("3", "first", 1)]
    assert {r["id"]: (r["matched"], r["first_seen"]) for r in second.state.collect()} == {"1": (0, "day1"), "2": (0, "day1"), "3": (1, "day2")}


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t", "id string, n int")
    assert t.version() == 0 and t.read().count() == 0
    t.write(spark.createDataFrame([("a", 1)], t.schema))
    t.write(t.read().unionByName(spark.createDataFrame([("b", 2)], t.schema)))
    assert t.version() == 2 and t.read().count() == 2


def test_health(spark):
    def runs(name, *entries):
        return [(name, *e) for e in entries]

    rows = runs("Broken", ("ok", 3, ""), ("error", 0, "x"), ("error", 0, "boom")) + runs("Drop", ("ok", 5, ""), ("ok", 0, "")) + runs("Blip", ("ok", 5, ""), ("error", 0, "x")) + runs("Fine", ("ok", 2, ""), ("unchanged", 0, ""))
    rows += runs("Stale", ("ok", 0, ""), ("ok", 0, "")) + runs("Shut", ("ok", 2, ""), ("blocked", 0, "robots")) + runs("Never", ("blocked", 0, "r"),) + runs("Skip", ("ok", 1, ""), ("skipped", 0, ""))
    log = spark.createDataFrame([(i, "d", c, s, n, e) for i, (c, s, n, e) in enumerate(rows)], RUN_LOG)
    assert {r["company"]: (r["kind"], r["message"]) for r in health.health_alerts(log).collect()} == {
        "Broken": ("failing", "Broken: 2 consecutive failed runs (boom)"), "Drop": ("zero_drop", "Drop: 0 jobs found (was 5) — parser may be broken"), "Shut": ("blocked", "Shut: blocked — robots"),
    }


def test_page_changes_and_cache(spark):
    pages = spark.createDataFrame([("a", 200, "x"), ("b", 304, None), ("c", 200, "new"), ("d", 200, "y")], "url string, status_code int, body string")
    cache = spark.createDataFrame([("a", "11f6ad8ec52a2984abaafd7c3b516503785c2072"), ("c", "old")], "url string, body_sha1 string")
    assert {r["url"]: r["outcome"] for r in store.page_changes(pages, cache).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "changed"}
    rows = spark.createDataFrame([("a", "2026-07-10T11:00:00"), ("b", "2026-07-08T11:00:00"), ("c", "never")], "host string, fetched_at string")
    assert [r["host"] for r in store.live(rows, "fetched_at", 86400, NOW).collect()] == ["a"]


def test_robots(spark):
    body = "User-agent: other\nDisallow: /\n\nUser-agent: *\n\nDisallow: /search$\nDisallow: /*?q=\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 5\n\nUser-agent: special\nDisallow: /only\n"
    files = spark.createDataFrame([("h.example", body)], "host string, body string")
    paths = ["/search", "/search/x", "/a?q=1", "/private/x", "/private/open/1", "/", "/only"]
    probe = spark.createDataFrame([(f"https://h.example{p}",) for p in paths] + [("https://none.example/x",)], "url string")
    got = {r["url"].split("example", 1)[1]: r["allowed"] for r in robots.decide(probe, files, "loombot").collect() if "none" not in r["url"]}
    assert [got[p] for p in paths] == [False, True, False, False, True, True, True]
    assert {r["url"]: r["allowed"] for r in robots.decide(probe, files, "special").collect()}["https://h.example/only"] is False
    assert robots.request_interval(files, "loombot").first()["seconds"] == 5.0


def test_discovery(spark):
    rows = [("https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "acme"), ("https://job-boards.greenhouse.io/acme", "greenhouse", "acme"), ("boards.greenhouse.io/embed/job_board?for=Acme1", "greenhouse", "Acme1"), ("https://jobs.eu.lever.co/x-y", "lever", "x-y"), ("https://x.wd5.myworkdayjobs.com/en-US/Site_1", "workday", None), ("nothing", None, None), ("https://jobs.lever.co/js then https://jobs.lever.co/real", "lever", "real")]
    got = table_of(spark, [r[:1] for r in rows], "t string", discovery.detect_ats(F.col("t")))
    assert [(g and g["ats"], g and g["token"]) for g in got] == [r[1:] for r in rows]
    pages = spark.createDataFrame([(1, "jobs.lever.co/B boards.greenhouse.io/a jobs.lever.co/b jobs.ashbyhq.com/A")], "k int, t string")
    assert [(r["pos"], r["name"]) for r in discovery.board_links(pages, "k", "t").orderBy("pos").collect()] == [(1, "a"), (2, "B")]
    found = spark.createDataFrame([("Acme, Inc", 1), ("ACME inc.", 2), ("Known", 3), ("!!", 4)], "name string, pos int")
    assert [r["pos"] for r in discovery.dedup_candidates(found, spark.createDataFrame([("known",)], "name string"), "pos").collect()] == [1]
    site = spark.createDataFrame([("s", i, u) for i, u in enumerate(["https://s.example/a/b/careers/1", "https://s.example/careers/", "https://s.example/careers", "https://s.example/jobs", "https://s.example/about"])], "site string, pos int, url string")
    assert [r["url"] for r in discovery.rank_careers(site, "site").orderBy("rank").collect()] == ["https://s.example/jobs", "https://s.example/careers", "https://s.example/a/b/careers/1"]


def test_sitemaps(spark):
    import gzip

    files = spark.createDataFrame([("https://s/i.xml", b"<sitemapindex><loc>https://s/i.xml</loc><loc> https://s/a.xml.gz </loc><loc>https://s/none.xml</loc></sitemapindex>"), ("https://s/a.xml.gz", gzip.compress(b"<urlset><loc>https://s/careers</loc><loc>https://s/x</loc></urlset>"))], "url string, content binary")
    seeds = spark.createDataFrame([("s", "https://s/i.xml", 0), ("t", "https://t/sitemap.xml", 0)], "site string, url string, pos int")
    assert [(r["site"], r["url"]) for r in discovery.sitemap_pages(seeds, sm.bodies(files)).orderBy("pos").collect()] == [("s", "https://s/careers"), ("s", "https://s/x")]
    assert sm.bodies(spark.createDataFrame([("x.gz", b"broken"), ("y.gz", None)], "url string, content binary")).where("body is not null").count() == 0


def test_html(spark):
    page = "<html><header>Logo</header><nav>Menu</nav><main><h1>Role</h1><p>Do   things<p>And more</p><div class='share x'>Share</div><script>bad()</script></main><footer>(c)</footer></html>"
    assert html.clean_text(page) == "Role\nDo things\nAnd more"
    assert html.clean_text("plain <b>bold") == "plain\nbold" and html.clean_text(None) == "" and html.clean_text("<p>" + "x" * 100, 50) == "x" * 50
    pages = spark.createDataFrame([("C", "https://c.example/list", '<ul><li class="j"><a href="/1">One</a><i class="l">Oslo</i><li class="j"><a href="b.pdf">Two</a><li class="j"><a href="/3"></a></ul>')], "company string, url string, html string")
    rows = html.listing(pages, {"job_item": "li.j", "link": "a", "location": ".l"})
    assert [(r["title"], r["url"], r["location"]) for r in rows.orderBy("pos").collect()] == [("One", "https://c.example/1", "Oslo"), ("Two", "https://c.example/b.pdf", "")]
    details = spark.createDataFrame([("https://c.example/1", "about one"), ("https://c.example/b.pdf", "binary")], "url string, text string")
    assert [r["description"] for r in landed.with_details(rows, details, 2, "pos").orderBy("pos").collect()] == ["about one", ""]


def test_sources(spark):
    gh = '{"jobs": [{"id": 7, "title": "T", "location": {"name": "L"}, "absolute_url": "u", "content": "&lt;p&gt;x", "updated_at": "2026"}, {"id": 8, "title": null, "location": null}]}'
    lv = '[{"id": "a", "text": "T", "categories": {"location": "L"}, "hostedUrl": "u", "descriptionPlain": "d", "createdAt": 1700000000000}]'
    df = spark.createDataFrame([("C", "greenhouse", gh), ("C", "lever", lv), ("C", "ashby", "broken"), ("D", "paper", "{}")], "company string, ats string, body string")
    posts, skipped = landed.normalise_all(df)
    assert sorted((r["title"], r["location"], r["description"], r["posted_at"]) for r in posts.collect()) == [("", "", "", ""), ("T", "L", "<p>x", "2026"), ("T", "L", "d", "1700000000000")]
    assert [(r["company"], r["status"]) for r in skipped.collect()] == [("D", "skipped")]
    assert posts.select("id").distinct().count() == 3
    page = lambda total, lo, n: '{"total": %d, "jobPostings": [%s]}' % (total, ",".join('{"title": "t%d", "externalPath": "/j/%d"}' % (i, i) for i in range(lo, lo + n)))
    wd = spark.createDataFrame([("W", "https://w", 0, page(21, 0, 20)), ("W", "https://w", 20, page(0, 20, 1)), ("W", "https://w", 40, page(0, 40, 5)), ("E", "https://e", 0, '{"total": 0}')], "company string, base_url string, offset int, body string")
    assert landed.workday(wd).count() == 21 and landed.workday(wd, 20).count() == 20
    spa = spark.createDataFrame([("S", '{"d": {"l": [{"x": {"t": "T"}, "url": "u"}, {"x": null}]}}'), ("S", "{}")], "company string, body string")
    assert sorted((r["title"], r["url"]) for r in landed.spa(spa, "d.l", {"title": "x.t"}).collect()) == [("", ""), ("T", "u")]


def test_greenhouse_descriptions_are_whole(spark, tmp_path):
    texts = ["<p>A &amp; B's \"é\"</p>\n&lt;i&gt;", "&" * 9000, "x", "", None]
    rows = [(i, "C", "greenhouse", "T", "L", "u", d, "2026") for i, d in enumerate(texts)]
    spark.createDataFrame(rows, "row_id bigint, company string, ats string, title string, location string, url string, description string, posted_at string").write.parquet(f"{tmp_path}/postings.parquet")
    got = [r["description"] for r in core_queries.source_normalise(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((d or "")[:8000] for d in texts)


def test_workday_pages_keep_whole_boards(spark, tmp_path):
    sizes = {"few": 3, "page": 40, "more": 41, "many": 95, "beyond": 2010}
    rows = [(i, c, f"t{i}", "L") for i, c in enumerate(c for c, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "seq bigint, company string, title string, location string").write.parquet(f"{tmp_path}/jobs.parquet")
    got = {r["company"]: r["count"] for r in core_queries.workday_pages(spark, str(tmp_path)).groupBy("company").count().collect()}
    assert got == sizes | {"beyond": 2000}  # the reference's max_jobs


def test_digest(spark):
    df = spark.createDataFrame([(1, i, f"line {i} " + "x" * 90) for i in range(200)] + [(2, 0, "y" * 5000)], "k int, pos int, line string")
    parts = digest.pack(df, "k", "pos", "line").collect()
    one_k = [r["message"] for r in sorted((r for r in parts if r["k"] == 1), key=lambda r: r["part"])]
    assert all(len(m) <= digest.LIMIT for m in one_k) and "\n".join(one_k).count("line ") == 200 and one_k[0].startswith("<b>200 fresh job(s)</b>")
    assert [len(r["message"]) for r in sorted((r for r in parts if r["k"] == 2), key=lambda r: r["part"])] == [len("<b>1 fresh job(s)</b>"), 5000]


def test_whole_digest(spark, tmp_path):
    import random

    r = random.Random(5)
    schema = "k int, pos int, line string"
    for rows in ([(1, i, f"{i} " + "é" * r.choice((0, 5, 90, 300))) for i in range(400)] + [(1, 400, "y" * 900), (1, 401, "z"), (1, 401, "a")], [(1, 0, "y" * 900)], []):
        df = spark.createDataFrame(rows, schema)
        want = sorted((x["part"], x["message"]) for x in digest.pack(df, "k", "pos", "line", 700).collect())
        for block in (7, 1000):
            assert sorted((x["part"], x["message"]) for x in digest.pack_whole(df, "pos", "line", 700, block).collect()) == want
    made = [(i, f"i{i}", f"c{i}", "Data Scientist", "London", f"https://a.example/{i}", "") for i in range(300)]
    spark.createDataFrame(made, "row_id bigint, id string, company string, title string, location string, url string, posted_at string").write.parquet(f"{tmp_path}/postings.parquet")
    spark.createDataFrame([], RUN_LOG).write.parquet(f"{tmp_path}/run_log.parquet")
    parts = [x["message"] for x in core_queries.digest_whole(spark, str(tmp_path)).orderBy("part").collect()]
    assert all(len(x) <= digest.LIMIT for x in parts) and "\n".join(parts).count("•") == 300 and parts[1].startswith("<b>300 fresh job(s)</b>\n")


def test_streaks_in_batches(spark):
    import random

    from hireloom.streaming.first_seen import STREAKS, error_streaks, merge_streaks

    r = random.Random(4)
    runs = [(i, f"c{r.randrange(5)}", r.choice(["ok", "error", "error", "skipped", "blocked"])) for i in range(120)]
    schema = "seq bigint, company string, status string"
    state = spark.createDataFrame([], STREAKS)
    for at in range(0, 120, 40):
        batch = spark.createDataFrame(runs[at : at + 40], schema)
        once = merge_streaks(state, batch)
        state = spark.createDataFrame(once.collect(), STREAKS)
        assert sorted(merge_streaks(state, batch).collect()) == sorted(state.collect())  # a batch that comes again
    whole = {x["company"]: x["streak"] for x in error_streaks(spark.createDataFrame(runs, schema)).collect()}
    assert {x["company"]: x["streak"] for x in state.collect() if x["streak"]} == whole


def test_outcomes_and_commit(spark):
    good = '{"jobs": [{"id": 1}, {"id": 2}]}'
    rows = [("A", "greenhouse", 200, good), ("B", "greenhouse", 200, "{broken"), ("C", "greenhouse", 304, None), ("D", "greenhouse", 403, ""), ("E", "paper", 200, "{}"), ("F", "lever", 200, "[]"), ("G", "lever", None, None)]
    df = spark.createDataFrame(rows, "company string, ats string, status_code int, body string")
    got = {r["company"]: (r["status"], r["jobs_found"], r["error"]) for r in landed.outcomes(df, landed.normalise_all(df)[0]).collect()}
    assert got == {"A": ("ok", 2, ""), "B": ("error", 0, "unreadable body"), "C": ("unchanged", 0, ""), "D": ("blocked", 0, "status 403"), "E": ("skipped", 0, ""), "F": ("ok", 0, ""), "G": ("error", 0, "status none")}
    cache = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "url string, body_sha1 string")
    pages = spark.createDataFrame([("a", "2", "changed"), ("b", "2", "changed"), ("c", "1", "unchanged"), ("d", "4", "changed")], "url string, body_sha1 string, outcome string")
    parsed = spark.createDataFrame([("a",), ("d",)], "url string")
    assert {r["url"]: r["body_sha1"] for r in store.commit_pages(cache, pages, parsed).collect()} == {"a": "2", "b": "1", "c": "1", "d": "4"}


def test_config(spark, tmp_path):
    from hireloom.sources import config

    (tmp_path / "companies.yaml").write_text("# ours\n- {name: A, tier: 0, ats: lever, token: a}\n- {name: B}\n- just text\n")
    config.add_entry(str(tmp_path / "companies.yaml"), {"name": "C", "ats": "ashby", "token": "c"})
    assert [(r["name"], r["ats"], r["token"]) for r in config.registry(spark, str(tmp_path / "companies.yaml")).collect()] == [("A", "lever", "a"), ("C", "ashby", "c")]
    assert (tmp_path / "companies.yaml").read_text().startswith("# ours")
    (tmp_path / "filters.yaml").write_text("roles: [Engineer]\nlocations: [Oslo]\ninclude_remote: true\nexperience: 0-2 years\nmax_days_old: 7\n")
    assert config.filters(str(tmp_path / "filters.yaml")) == match.Filters(("Engineer",), ("Oslo",), True, "0-2 years", 7)
    (tmp_path / "tokens.txt").write_text("# c\n\n acme \nbeta\n")
    assert [r["name"] for r in config.tokens(spark, str(tmp_path / "tokens.txt")).collect()] == ["acme", "beta"]
    assert config.tokens(spark, str(tmp_path / "none.txt")).count() == 0


def test_names_and_gates(spark):
    made = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert sorted(r["name"] for r in discovery.known_names(made("a", ""), made("a", "b"), made(None, "c")).collect()) == ["a", "b", "c"]
    assert [r["name"] for r in discovery.without(made("a", "b"), made("a"), "name").collect()] == ["b"]
    probes = spark.createDataFrame([("a", 2, "lever", "x", 3), ("a", 1, "greenhouse", "x", 0), ("a", 3, "ashby", "x", 9), ("b", 1, "lever", "y", 0)], "name string, rank int, ats string, token string, jobs_found int")
    assert [(r["name"], r["ats"]) for r in discovery.resolve(probes).collect()] == [("a", "lever")]
    counts = spark.createDataFrame([("a", 2), ("b", 0)], "name string, jobs_found int")
    assert {r["name"]: (r["approved"], r["error"]) for r in discovery.approve(made("a", "b", "c"), counts).collect()} == {"a": (True, None), "b": (False, "no postings found"), "c": (False, "no postings found")}
    queue = spark.createDataFrame([("a", 3, None), ("b", 1, "done"), ("c", 2, None)], "name string, pos int, llm string")
    assert [r["name"] for r in discovery.infer_queue(queue, 1).collect()] == ["c"]
    found = landed.jsearch(spark.createDataFrame([('{"data": [{"employer_name": "A", "employer_website": null}, {"employer_name": ""}]}',)], "body string"))
    assert [tuple(r) for r in found.collect()] == [("A", "")]


def test_browse(spark):
    from hireloom.operators import browse

    rows = [(f"{i}", "A" if i % 2 else "B", f"Data {i}", "Oslo", "u", None if i == 3 else "p", f"2026-01-{i % 3 + 1:02d}", i % 2) for i in range(120)]
    state = spark.createDataFrame(rows, STATE)
    total, first = browse.search(state, q="DATA", matched="0")
    assert total.first()["total"] == 60 and first.count() == 50
    assert browse.search(state, q="DATA", matched="1", offset=50)[1].count() == 10
    assert browse.search(state, q="%_1")[0].first()["total"] == sum(len(str(i)) > 0 and "1" in f"Data {i}"[1:] for i in range(120))
    assert browse.totals(state.limit(0), spark.createDataFrame([], RUN_LOG)).first().asDict() == {"total": 0, "matched": 0, "last_run": None}
    assert '"posted_at":null' in browse.as_json(browse.search(state.where("id = '3'"))[1]).first()["json"]


def test_keyed_log(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([*r], "id string, n int")
    log = store.KeyedLog(spark, f"file://{tmp_path}/log", "id string, n int", "id", part_rows=2, most_folders=4)
    assert log.read().count() == 0
    log.write(rows(*[(f"k{i}", i) for i in range(20)]), "a")
    log.write(rows(("k3", 33), ("new", 1)), "b")
    log.write(rows(("k3", 99)), "b")  # a name that counts already
    held = lambda log: {r["id"]: r["n"] for r in log.read().collect()}
    assert held(log)["k3"] == 33 and len(held(log)) == 21 and list(log.folders().values())[0] == 10
    few = log.read(rows(("k3", 0)))
    assert {r["id"]: r["n"] for r in few.collect()}["k3"] == 33 and few.count() < 12
    (tmp_path / "log" / "000000000009~add~dead~1").mkdir()  # a write that was killed
    assert len(held(log)) == 21
    for i in range(4):
        log.write(rows(("last", i)), f"c{i}")
    assert len(log.folders()) <= 4 and held(log)["last"] == 3 and held(store.KeyedLog(spark, f"file://{tmp_path}/log", "id string, n int", "id")) == held(log)


def test_delta_state_is_the_merged_state(spark, tmp_path):
    import random

    r = random.Random(8)
    cols = "n int, id string, company string, title string, location string, url string, posted_at string, matched int"
    made = lambda seed: spark.createDataFrame([(i, r.choice(["a", "b", "c", "d", None, f"x{seed}{i}"]), "c", f"t{seed}", "l", "u", "p", r.randrange(2)) for i in range(12)], cols)
    delta, state = store.DeltaState(spark, f"file://{tmp_path}/state", STATE, part_rows=3), spark.createDataFrame([], STATE)
    for k in range(3):
        batch = spark.createDataFrame(made(k).collect(), cols)
        want = store.merge(state, batch, "n", f"day{k}")
        for again in (False, True):  # a batch that comes again has nothing new
            got = delta.merge(batch, "n", f"day{k}", f"batch{k}")
            assert {x["id"] for x in got.new.collect()} == (set() if again else {x["id"] for x in want.new.collect()})
            assert {x["id"] for x in got.fresh.collect()} == (set() if again else {x["id"] for x in want.fresh.collect()})
        state = spark.createDataFrame(want.state.collect(), STATE)
        assert sorted(map(tuple, delta.read().collect())) == sorted(map(tuple, state.collect()))
    written = sum(delta.rows.spark.read.parquet(f"{delta.rows.path}/{m}").count() for m in delta.rows.folders())
    assert written == state.count()  # each row once, whatever the number of batches


def test_gate(spark):
    files = spark.createDataFrame([("h.example", "User-agent: *\nDisallow: /private\nCrawl-delay: 4"), ("api.lever.co", "User-agent: *\nDisallow: /")], "host string, body string")
    probe = spark.createDataFrame([("https://h.example/a",), ("https://h.example/a",), ("https://h.example/private/1",), ("https://api.lever.co/v0",), ("https://none.example/",), ("ftp://h.example/a",), ("http://192.168.0.1/",)], "url string")
    got = {r["url"]: (r["outcome"], r["reason"], r["seconds"]) for r in robots.gate(probe, files, "loombot").collect()}
    assert got == {
        "https://h.example/a": ("fetch", None, 4.0), "https://h.example/private/1": ("blocked", "robots", None), "https://api.lever.co/v0": ("fetch", None, 1.0), "https://none.example/": ("fetch", None, 1.0), "ftp://h.example/a": ("blocked", "scheme", None), "http://192.168.0.1/": ("blocked", "private", None),
    }
    assert robots.gate(probe.limit(0), files, "loombot").count() == 0


def test_hot_host_is_looked_up(spark):
    files = spark.createDataFrame([("hot.example", "User-agent: *\nDisallow: /x")], "host string, body string")
    probe = spark.createDataFrame([(f"https://hot.example/{'x' if i % 2 else 'y'}/{i}",) for i in range(3000)], "url string")
    assert robots.decide(probe, files, "loombot").where("allowed").count() == 1500


def test_cascade(spark):
    cands = spark.createDataFrame([("U", "https://jobs.lever.co/u"), ("P", "https://p.example/"), ("C", "https://c.example/"), ("Na Me", "https://n.example/"), ("No", None), ("Dead", "https://jobs.lever.co/dead"), ("W", "https://x.wd1.myworkdayjobs.com/Site")], "name string, url string")
    pages = spark.createDataFrame([("https://p.example/", "boards.greenhouse.io/p jobs.lever.co/other"), ("https://c.example/jobs", "jobs.ashbyhq.com/c"), ("https://jobs.lever.co/u", "boards.greenhouse.io/never"), ("https://n.example/", "none")], "url string, body string")
    careers = spark.createDataFrame([("C", 1, "https://c.example/x"), ("C", 2, "https://c.example/jobs"), ("C", 4, "https://jobs.lever.co/late"), ("P", 1, "https://jobs.lever.co/late")], "name string, rank int, url string")
    probes = spark.createDataFrame([("lever", "u", None, None, 4), ("greenhouse", "p", None, None, 1), ("ashby", "c", None, None, 2), ("greenhouse", "name", None, None, 0), ("lever", "name", None, None, 6), ("ashby", "name", None, None, 9), ("ashby", "no", None, None, 1), ("lever", "dead", None, None, 0), ("greenhouse", "dead", None, None, 5), ("workday", None, "x.wd1.myworkdayjobs.com", "Site", 8)], "ats string, token string, host string, site string, jobs_found int")
    got = {r["name"]: (r["via"], r["ats"], r["token"], r["jobs_found"]) for r in discovery.cascade(cands, pages, careers, probes).collect()}
    assert got == {"U": ("url", "lever", "u", 4), "P": ("page", "greenhouse", "p", 1), "C": ("careers", "ashby", "c", 2), "Na Me": ("name", "lever", "name", 6), "No": ("name", "ashby", "no", 1), "W": ("url", "workday", None, 8)}


def test_six_kinds(spark):
    page = '<div class="j"><a href="/1">One</a></div>'
    rows = [
        ("W", "workday", "https://w", 0, '{"total": 21, "jobPostings": [%s]}' % ",".join('{"title": "t%d", "externalPath": "/%d"}' % (i, i) for i in range(20)), None), ("W", "workday", "https://w", 20, '{"total": 0, "jobPostings": [{"title": "t20", "externalPath": "/20"}]}', None),
        ("S", "spa", None, None, '{"a": [{"n": "T", "url": "u"}]}', {"jobs_path": "a", "title": "n"}), ("R", "spa", None, None, '[{"title": "Q"}]', {"jobs_path": ""}), ("H", "html", "https://h.example/list", None, page, {"job_item": "div.j"}), ("B", "html", "https://h.example/list", None, page, None), ("X", None, None, None, "{}", None),
    ]
    posts, skipped = landed.normalise_all(spark.createDataFrame(rows, "company string, ats string, url string, offset int, body string, config map<string,string>"))
    got = sorted((r["company"], r["title"], r["url"], r["source_tier"]) for r in posts.collect())
    assert got[:3] == [("H", "One", "https://h.example/1", 1), ("R", "Q", "", 2), ("S", "T", "u", 2)] and len(got) == 24
    assert [r["company"] for r in skipped.collect()] == ["X"]


def test_places_of_equal_order_keep_the_limit(spark):
    rows = spark.createDataFrame([("C", 0, f"https://c.example/{i}", "") for i in range(9)], "company string, pos int, url string, description string")
    details = rows.select("url", F.lit("text").alias("text"))
    assert landed.with_details(rows, details, 4, "pos").where("description = 'text'").count() == 4


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    import pytest

    from hireloom import common

    conf, context = SimpleNamespace(get=lambda *_: None), SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_config_is_checked_and_replaced_whole(spark, tmp_path):
    import pytest

    from hireloom.sources import config

    path = f"{tmp_path}/pending.yaml"
    config.rewrite(path, [{"name": "Ä", "ats": "lever"}, {"name": "B"}])
    config.rewrite(path, [{"name": "C", "ats": "ashby"}])
    assert (tmp_path / "pending.yaml").read_text() == "- name: C\n  ats: ashby\n"
    with pytest.raises(ValueError):
        config.add_entry(path, {"ats": "lever"})
    assert config.registry(spark, f"{tmp_path}/none.yaml").count() == 0 and not (tmp_path / "pending.yaml.making").exists()


def test_wide_pages_and_hidden_parts():
    import time

    began = time.perf_counter()
    wide = "<main>" + "<div class='ad'>no</div><p>yes" * 20_000 + "</main>"
    assert html.clean_text(wide, 10**6) == "\n".join(["yes"] * 20_000) and time.perf_counter() - began < 20
    assert html.clean_text("<div class='menu'><main>hidden main</main></div><p>shown</p>") == "shown"


def packed(rows, limit):
    """Line by line, key by key."""
    out = {}
    for k in {r[0] for r in rows}:
        own = [line for _, _, line in sorted(r for r in rows if r[0] == k)]
        messages = [f"<b>{len(own)} fresh job(s)</b>"]
        for x in own:
            if len(messages[-1]) + len(x) + 1 > limit:
                messages.append(x)
            else:
                messages[-1] += "\n" + x
        out |= {(k, i): m for i, m in enumerate(messages)}
    return out


def test_digests_of_many_keys_in_blocks(spark):
    import random

    r = random.Random(6)
    rows = [(k, i, f"{i} " + "é" * r.choice((0, 5, 90, 300, 800))) for k, n in ((None, 70), (1, 300), (2, 1), (3, 40), (4, 2), (7, 90)) for i in range(n)] + [(7, 3, "twice"), (7, 3, "twice")]
    df = spark.createDataFrame(rows, "k int, pos int, line string")
    for block in (5, 60, 10_000):
        got = [tuple(x) for x in digest.pack(df, "k", "pos", "line", 700, block).collect()]
        assert {(k, p): m for k, p, m in got} == packed(rows, 700) and len(got) == len(packed(rows, 700))
    assert digest.pack(df.limit(0), "k", "pos", "line").count() == 0
