"""The core queries in DuckDB's SQL, over the whole tables."""

from __future__ import annotations

from hireloom.functions import match, urls
from hireloom.functions.dates import AGO
from hireloom.operators.discovery import BOARDS, CAREERS, NOT_TOKENS, WORKDAY

#: The roles and locations of the queries' filters, and the time that counts as now.
ROLES, LOCATIONS = ("Software Engineer", "Machine Learning Engineer", "Data Scientist", "Customer Manager"), ("London", "Bengaluru", "Berlin", "New York City")
NOW = "TIMESTAMP '2026-08-31 12:00:00'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _part(url: str, name: str) -> str:
    group = {"scheme": 1, "authority": 3, "path": 4, "query": 6}[name]
    return f"regexp_extract({url}, {_q(urls.PARTS)}, {group})"


def _host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_part(url, 'authority')}, '^.*@', ''), ':[0-9]*$', ''))"


def _canonical(url: str) -> str:
    scheme, authority, path, query = (_part(url, x) for x in ("scheme", "authority", "path", "query"))
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'gh_')), '&')"
    return (
        f"(CASE WHEN {scheme} <> '' THEN lower({scheme}) || ':' ELSE '' END || CASE WHEN {authority} <> '' THEN '//' || lower({authority}) ELSE '' END || "
        f"CASE WHEN {authority} <> '' AND {path} <> '' AND NOT starts_with({path}, '/') THEN '/' ELSE '' END || {path} || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"
    )


def _id(company: str, native: str, url: str, title: str, location: str) -> str:
    c, n, u, t, p = (f"coalesce({x}, '')" for x in (company, native, url, title, location))
    return f"sha1(CASE WHEN {n} <> '' THEN {c} || ':' || {n} WHEN {u} <> '' THEN {_canonical(u)} ELSE concat_ws('|', {c}, {t}, {p}) END)"


_SHORT = "replace(replace(lower(title), 'machine learning', 'ml'), 'artificial intelligence', 'ai')"
_TITLE = f"coalesce(regexp_matches({_SHORT}, {_q('|'.join(match.role_pattern(r) for r in ROLES))}), false)"
_LOCATION = f"coalesce(regexp_matches(location, {_q(match.location_pattern(LOCATIONS).replace(chr(92) + ' ', ' '))}) OR lower(trim(location)) = 'remote', false)"
MATCHED = f"({_TITLE} AND {_LOCATION})"

# Required years without look-ahead: the words that rule a match out are taken in, and such matches left out.
_YEARS = r"(?i)\d{1,2}\s*(?:-|–|to)?\s*\d*\s*\+?\s*years?\b(?:\s*(?:ago|old))?"
_OVER = lambda c: f"len(list_filter(regexp_extract_all({c}, {_q(_YEARS)}), lambda m: NOT regexp_matches(m, '(?i)(ago|old)$') AND CAST(regexp_extract(m, '^([0-9]{{1,2}})', 1) AS INT) > 2)) > 0"
_NO_U = lambda p: p.replace("(?iU)", "(?i)")
EXPERIENCE = f"""CASE WHEN regexp_matches(t, {_q(_NO_U(match.JUNIOR))}) THEN true WHEN regexp_matches(t, {_q(_NO_U(match.SENIOR))}) THEN false
    WHEN regexp_matches(regexp_replace(t, {_q(_YEARS)}, '', 'g'), {_q(_NO_U(match.LEVEL))}) THEN false ELSE NOT ({_OVER('t')}) AND NOT ({_OVER('d')}) END"""

_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,6})\d*)?)?(Z|[+-]\d{2}:?\d{2})?$"
_I = lambda g: f"regexp_extract(posted_at, {_q(_ISO)}, {g})"
_STAMP = f"""try_cast({_I(1)} || ' ' || CASE WHEN {_I(2)} = '' THEN '00:00' ELSE {_I(2)} END || CASE WHEN {_I(3)} = '' THEN ':00' ELSE {_I(3)} END || '.' || rpad({_I(4)}, 6, '0') AS TIMESTAMP)"""
_SHIFT = f"""CASE WHEN {_I(5)} IN ('', 'Z') THEN 0 ELSE (CASE WHEN {_I(5)}[1] = '-' THEN -1 ELSE 1 END) * (CAST({_I(5)}[2:3] AS INT) * 60 + CAST({_I(5)}[-2:] AS INT)) END"""
_AGO = lambda g: f"regexp_extract(posted_at, {_q(AGO)}, {g})"
POSTED_US = f"""CASE WHEN regexp_matches(posted_at, '^[0-9]+$') THEN CASE WHEN try_cast(posted_at AS BIGINT) BETWEEN 0 AND 253402300799999 THEN try_cast(posted_at AS BIGINT) * 1000 END
    WHEN regexp_matches(posted_at, {_q(AGO)}) THEN epoch_us({NOW}) - 86400000000 * (CASE WHEN {_AGO(1)} <> '' THEN 0 WHEN {_AGO(2)} <> '' THEN 1 ELSE try_cast({_AGO(3)} AS BIGINT) END)
    WHEN regexp_matches(posted_at, {_q(_ISO)}) THEN epoch_us({_STAMP}) - 60000000 * CAST({_SHIFT} AS BIGINT) END"""
RECENT = f"coalesce(floor((epoch_us({NOW}) - ({POSTED_US})) / 86400000000.0) <= 60, true)"

_FIRST = lambda c, o, t: f"(SELECT DISTINCT ON (id) id, {c} FROM {t} WHERE id IS NOT NULL ORDER BY id, {o})"
STATE = _FIRST("company, title, first_seen, matched", "seq", "jobs")
BATCH = f"(SELECT p.id, p.company, p.title, p.location, m.matched FROM {_FIRST('company, title, location', 'row_id', 'postings')} p JOIN (SELECT id, max(CAST({MATCHED} AS INT)) matched FROM postings GROUP BY id) m USING (id))"

LOG = """r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq DESC) rn FROM run_log WHERE status <> 'skipped'),
w AS (SELECT company, coalesce(min(CASE WHEN status <> 'error' THEN rn END) - 1, count(*)) streak, max(CASE WHEN rn = 1 THEN status END) last_status, max(CASE WHEN rn = 1 THEN error END) last_error FROM r WHERE rn <= 10 GROUP BY company),
o AS (SELECT company, jobs_found, row_number() OVER (PARTITION BY company ORDER BY seq DESC) k FROM run_log WHERE status = 'ok'),
p AS (SELECT company, max(CASE WHEN k = 1 THEN jobs_found END) cur, max(CASE WHEN k = 2 THEN jobs_found END) prev, count(*) n_ok FROM o WHERE k <= 2 GROUP BY company)"""

_BODY = """(SELECT company_id, name, CASE WHEN ats = 'workday' THEN 'https://x.wd5.myworkdayjobs.com/en-US/' || coalesce(token, 'site')
    ELSE coalesce(CASE ats WHEN 'greenhouse' THEN 'see https://boards.greenhouse.io/embed/job_board?for=' WHEN 'lever' THEN 'see https://jobs.lever.co/' WHEN 'ashby' THEN 'see https://jobs.ashbyhq.com/' END
      || coalesce(token, 'embed') || '"> and https://jobs.lever.co/Extra<a href="https://jobs.lever.co/extra">', 'no board') END body FROM companies)"""
_NOT = ", ".join(_q(t) for t in NOT_TOKENS)
_TOK = lambda p: f"list_filter(regexp_extract_all(body, {_q(p)}, 1), lambda t: lower(t) NOT IN ({_NOT}))"
_DETECT = f"""(SELECT company_id, name, CASE WHEN regexp_matches(body, {_q(WORKDAY)}) THEN 'workday' {' '.join(f"WHEN len({_TOK(p)}) > 0 THEN '{a}'" for a, p, _ in BOARDS)} END ats,
    CASE WHEN regexp_matches(body, {_q(WORKDAY)}) THEN NULL {' '.join(f"WHEN len({_TOK(p)}) > 0 THEN {_TOK(p)}[1]" for a, p, _ in BOARDS)} END token,
    CASE WHEN regexp_matches(body, {_q(WORKDAY)}) THEN regexp_extract(body, {_q(WORKDAY)}, 1) END host, CASE WHEN regexp_matches(body, {_q(WORKDAY)}) THEN regexp_extract(body, {_q(WORKDAY)}, 2) END site FROM {_BODY})"""
_LINKS = " UNION ALL ".join(f"SELECT company_id, {i} rk, unnest({_TOK(p)}) nm, generate_subscripts({_TOK(p)}, 1) ps, '{b}' base FROM {_BODY}" for i, (a, p, b) in enumerate(BOARDS))
_NORM = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_DEPTH = lambda u: f"length(regexp_replace(regexp_replace({_part(u, 'path')}, '^/+|/+$', '', 'g'), '[^/]', '', 'g'))"
_NWWW = lambda u: f"regexp_replace({_host(u)}, '^www\\.', '')"
_S = lambda c: f"coalesce({c}, '')"
_STRIP = lambda c: f"regexp_replace(coalesce({c}, ''), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
_PLAIN = lambda c: f"regexp_replace({_STRIP(c)}, '[ \\t\\r\\f\\v]+', ' ', 'g')"


def _escaped(c: str) -> str:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{sign}', '{name}')"
    return c


_LINE = f"""'• <a href="' || {_escaped(_S('url'))} || '">' || {_escaped(_S('title'))} || '</a> — ' || {_escaped(_S('company'))} || ' (' || {_escaped(_S('location'))} || ')'"""
# Lines, each a list of its own, folded into messages of at most 4,000 signs behind a header.
_FOLDED = """list_reduce(list_prepend(['<b>' || count(*) || ' fresh job(s)</b>'], list([line] ORDER BY row_id, line)),
    lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + 1 > 4000 THEN list_append(a, x[1]) ELSE list_append(a[:-2], a[-1] || chr(10) || x[1]) END)"""
# Responses of a run by company: the worst outcome, and the postings of those that were read.
_RUN = f"""(SELECT company, CASE w WHEN 1 THEN 'blocked' WHEN 2 THEN 'ok' WHEN 3 THEN 'unchanged' ELSE 'skipped' END status, CASE WHEN w = 2 THEN n ELSE 0 END::INT jobs_found, CASE WHEN w = 1 THEN 'status 403' ELSE '' END error FROM
    (SELECT {_S('company')} company, min(CASE WHEN ats IS NULL THEN 4 WHEN row_id % 7 = 0 THEN 3 WHEN row_id % 11 = 0 THEN 1 ELSE 2 END) w,
        count(*) FILTER (ats IS NOT NULL AND row_id % 7 <> 0 AND row_id % 11 <> 0 AND (ats <> 'html' OR {_STRIP('title')} <> '')) n FROM postings GROUP BY 1))"""

SQL: dict[str, str] = {
    "match_postings": f"SELECT row_id FROM postings WHERE {MATCHED}",
    "experience_filter": f"SELECT row_id, {EXPERIENCE} ok FROM (SELECT row_id, coalesce(title, '') t, coalesce(description, '') d FROM postings)",
    "posted_recency": f"SELECT row_id, CAST(floor(({POSTED_US}) / 1000000.0) AS BIGINT) posted_s, {RECENT} recent FROM postings",
    "full_match": f"SELECT row_id FROM (SELECT *, coalesce(title, '') t, coalesce(description, '') d FROM postings) WHERE {MATCHED} AND {RECENT} AND {EXPERIENCE}",
    "first_seen_new": f"SELECT id, company, title, location FROM {BATCH} WHERE matched = 1 AND id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)",
    "merge_state": f"""SELECT s.id, s.company, s.title, s.first_seen, coalesce(b.matched, s.matched) matched FROM {STATE} s LEFT JOIN {BATCH} b USING (id)
        UNION ALL SELECT id, company, title, '2026-09-01T00:00:00+00:00', matched FROM {BATCH} WHERE id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)""",
    "merge_new": f"SELECT id, company, title, '2026-09-01T00:00:00+00:00' first_seen, matched FROM {BATCH} WHERE id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)",
    "dedup_first": "SELECT sha1(text) sha, min(doc_id) doc_id, count(*) n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "dedup_any_matched": f"SELECT f.id, f.title, m.matched FROM {_FIRST('title', 'seq', 'jobs')} f JOIN (SELECT id, max(matched) matched FROM jobs GROUP BY id) m USING (id)",
    "last_write": "SELECT DISTINCT ON (company) seq, company, run_date, status, jobs_found FROM run_log ORDER BY company, seq DESC",
    "canonical_urls": f"SELECT row_id, {_canonical('url')} canonical FROM postings WHERE url IS NOT NULL",
    "posting_ids": f"SELECT row_id, {_id('company', 'native', 'url', 'title', 'location')} made_id FROM (SELECT *, CASE WHEN ats = 'greenhouse' THEN CAST(row_id AS VARCHAR) END native FROM postings)",
    "host_rollup": f"SELECT {_NWWW(_S('url'))} host, count(*) n_urls FROM postings GROUP BY 1",
    "url_flags": f"""SELECT company_id, regexp_matches(lower({_part('u', 'path')}), {_q(chr(92) + '.(?:' + '|'.join(urls.BINARY_SUFFIXES) + ')$')}) is_binary,
        {_host('u')} IN ({', '.join(_q(h) for h in urls.API_HOSTS)}) OR ends_with({_host('u')}, {_q(urls.API_SUFFIX)}) is_api, regexp_matches({_part('u', 'path')}, {_q(CAREERS)}) is_careers
        FROM (SELECT company_id, coalesce(careers_url, '') || CASE WHEN company_id % 2 = 0 THEN 'Brochure.PDF?x=1' ELSE 'jobs' END u FROM companies)""",
    "url_policy": "SELECT company_id, CASE company_id % 5 WHEN 1 THEN 'scheme' WHEN 2 THEN 'credentials' WHEN 3 THEN 'private' END reason FROM companies",
    "health_alerts": f"""WITH {LOG}, k AS (SELECT w.company, CASE WHEN streak >= 2 THEN 'failing' WHEN last_status = 'blocked' AND n_ok IS NOT NULL THEN 'blocked' WHEN last_status <> 'blocked' AND cur = 0 AND prev > 0 THEN 'zero_drop' END kind,
        streak, cur, prev, substring(coalesce(last_error, ''), 1, 120) e FROM w LEFT JOIN p USING (company))
        SELECT company, kind, streak, cur, prev, CASE kind WHEN 'failing' THEN company || ': ' || streak || ' consecutive failed runs (' || e || ')' WHEN 'blocked' THEN company || ': blocked — ' || e
        ELSE company || ': 0 jobs found (was ' || prev || ') — parser may be broken' END message FROM k WHERE kind IS NOT NULL""",
    "error_streaks": """WITH r AS (SELECT * FROM run_log WHERE status <> 'skipped'), g AS (SELECT company, max(CASE WHEN status <> 'error' THEN seq END) good FROM r GROUP BY company)
        SELECT company, count(*) streak FROM r JOIN g USING (company) WHERE status = 'error' AND (good IS NULL OR seq > good) GROUP BY company""",
    "run_states": f"WITH {LOG} SELECT company, streak, last_status FROM w",
    "company_facets": "SELECT company, count(*) n_jobs FROM jobs GROUP BY company ORDER BY company",
    "meta_totals": "SELECT count(*) total, coalesce(sum(matched), 0)::BIGINT matched, (SELECT max(run_date) FROM run_log) last_run FROM jobs",
    "search_page": "SELECT company, title, location, url, posted_at, first_seen, matched FROM jobs WHERE (title ILIKE '%engineer%' OR location ILIKE '%engineer%') AND matched = 1 ORDER BY first_seen DESC NULLS LAST, posted_at DESC NULLS LAST, seq LIMIT 50 OFFSET 20",
    "search_count": "SELECT count(*) total FROM jobs WHERE title ILIKE '%data_%%' OR location ILIKE '%data_%%'",
    "ui_index": "SELECT tier, name, lpad(CAST(row_number() OVER (PARTITION BY tier ORDER BY name) AS VARCHAR), 3, '0') idx FROM (SELECT DISTINCT tier, name FROM companies)",
    "run_summary": f"""SELECT company, count(*) jobs, count(*) FILTER ({MATCHED}) matched, count(DISTINCT CASE WHEN id IS NOT NULL AND id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL) THEN id END) "new" FROM postings GROUP BY company""",
    "page_change": """WITH p AS (SELECT row_id, url, description, batch_no FROM postings WHERE url IS NOT NULL AND url <> ''), c AS (SELECT url, arg_max(coalesce(sha1(description), '-'), row_id) sha FROM p WHERE batch_no <= 15 GROUP BY url)
        SELECT row_id, CASE WHEN coalesce(sha1(description) = sha, false) THEN 'unchanged' ELSE 'changed' END outcome FROM p LEFT JOIN c USING (url) WHERE batch_no > 15""",
    "live_cache": f"SELECT seq FROM run_log WHERE epoch({NOW}) - epoch(try_cast(run_date AS TIMESTAMPTZ)) < 30 * 86400",
    "robots_decision": f"""WITH u AS (SELECT DISTINCT url, {_part('url', 'path')} || CASE WHEN {_part('url', 'query')} <> '' THEN '?' || {_part('url', 'query')} ELSE '' END path FROM postings WHERE url IS NOT NULL AND url <> ''),
        r(pattern, size, allow) AS (VALUES ('^/openings/1', 11, false), ('^/openings/1.*5$', 14, true), ('^/.*\\?q=', 6, false))
        SELECT url, coalesce(arg_max(allow, {{'s': size, 'a': allow}}), true) allowed FROM u LEFT JOIN r ON regexp_matches(path, pattern) GROUP BY url""",
    "request_interval": f"SELECT DISTINCT lower({_part('url', 'authority')}) host, 2.0::DOUBLE AS \"seconds\" FROM postings WHERE url IS NOT NULL AND url <> ''",
    "ats_detect": f"SELECT company_id, ats, token, host, site FROM {_DETECT}",
    "board_links": f"""WITH l AS ({_LINKS}), f AS (SELECT DISTINCT ON (company_id, lower(nm)) * FROM l ORDER BY company_id, lower(nm), rk, ps)
        SELECT company_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY rk, ps) AS INT) pos, nm AS name, base || nm url FROM f""",
    "registry_entries": f"SELECT company_id, CASE WHEN ats IS NOT NULL THEN name END AS name, CASE WHEN ats IS NOT NULL THEN 0 END tier, ats, token FROM {_DETECT}",
    "careers_rank": f"""WITH h AS (SELECT {_NWWW('url')} site, row_id, url, {_DEPTH('url')} d, length(url) n, regexp_replace(url, '/+$', '') k FROM postings WHERE url IS NOT NULL AND url <> '' AND regexp_matches({_part('url', 'path')}, {_q(CAREERS)})),
        f AS (SELECT DISTINCT ON (site, k) * FROM h ORDER BY site, k, d, n, row_id), r AS (SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY d, n, row_id) AS INT) AS rank, url FROM f) SELECT site, rank, url FROM r WHERE rank <= 5""",
    "careers_default": """WITH s AS (SELECT company_id site, tier, regexp_replace(careers_url, '/+$', '') root FROM companies WHERE careers_url IS NOT NULL)
        SELECT site, 1 AS rank, root || '/careers/all' url FROM s WHERE tier = 0 UNION ALL SELECT site, v.n, root || v.p FROM s, (VALUES (1, '/careers'), (2, '/careers/'), (3, '/jobs')) v(n, p) WHERE tier IS DISTINCT FROM 0""",
    "sitemap_bfs": f"SELECT DISTINCT {_NWWW('url')} site, url, 1 AS level FROM postings WHERE url IS NOT NULL AND url <> '' AND ats IN ('html', 'spa')",
    "candidate_dedup": f"""SELECT company AS name, row_id FROM (SELECT DISTINCT ON (k) k, company, row_id FROM (SELECT {_NORM('company')} k, company, row_id FROM postings WHERE company IS NOT NULL) WHERE k <> '' ORDER BY k, row_id)
        WHERE k NOT IN (SELECT {_NORM('name')} FROM companies)""",
    "known_names": "SELECT name FROM (SELECT name FROM companies UNION SELECT company FROM jobs UNION SELECT company FROM run_log) WHERE name <> ''",
    "unresolved": "SELECT name FROM companies WHERE name NOT IN (SELECT company FROM jobs WHERE company IS NOT NULL)",
    "resolve_probe": f"SELECT DISTINCT ON (company) company AS name, {_NORM('company')} token, seq AS rank, jobs_found FROM run_log WHERE jobs_found > 0 ORDER BY company, seq",
    "approve_gate": "SELECT c.name, coalesce(n, 0) > 0 approved, CASE WHEN coalesce(n, 0) > 0 THEN NULL ELSE 'no postings found' END error FROM companies c LEFT JOIN (SELECT company, count(*) FILTER (matched = 1) n FROM jobs GROUP BY 1) j ON j.company = c.name",
    "evidence": """WITH r AS (SELECT company, coalesce(title, '') t, row_number() OVER (PARTITION BY company ORDER BY seq) k FROM jobs)
        SELECT company, count(*) || ' jobs live; sample: ' || string_agg(t, '; ' ORDER BY k) FILTER (k <= 3) evidence FROM r GROUP BY company""",
    "infer_verdicts": """SELECT company_id, t.tier, CASE WHEN t.tier IS NOT NULL THEN ats END ats, CASE WHEN t.tier IS NULL THEN NULL WHEN ats IN ('greenhouse', 'lever', 'ashby') THEN token WHEN ats = 'workday' THEN 'h.wd1.myworkdayjobs.com' WHEN ats = 'html' THEN '{}' ELSE careers_url END "by"
        FROM (SELECT *, CASE WHEN ats IN ('greenhouse', 'lever', 'ashby') AND coalesce(token, '') <> '' THEN 0 WHEN ats = 'workday' AND company_id % 2 = 0 THEN 0 WHEN ats = 'html' THEN 1 WHEN ats = 'spa' AND careers_url IS NOT NULL THEN 2 END vt FROM companies) c, LATERAL (SELECT c.vt AS tier) t""",
    "json_paths": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') k, coalesce(json_extract_string(props, '$.a.b'), '') ab FROM events",
    "source_normalise": f"""SELECT CASE WHEN ats = 'html' THEN {_id(_S('company'), "''", "'https://c.example/j/' || row_id", 'title', 'location')} WHEN ats = 'workday' THEN sha1({_S('company')} || ':/job/' || row_id) ELSE sha1({_S('company')} || ':' || row_id) END id,
        {_S('company')} company, CASE WHEN ats = 'html' THEN {_STRIP('title')} ELSE {_S('title')} END title, CASE WHEN ats = 'html' THEN {_STRIP('location')} ELSE {_S('location')} END AS location,
        CASE ats WHEN 'html' THEN 'https://c.example/j/' || row_id WHEN 'workday' THEN 'https://h.example/en-US/s/job/' || row_id ELSE {_S('url')} END url,
        CASE WHEN ats IN ('greenhouse', 'lever', 'ashby') THEN substring({_S('description')}, 1, 8000) ELSE '' END description,
        CASE WHEN ats = 'lever' THEN CAST(row_id * 1000 AS VARCHAR) WHEN ats IN ('greenhouse', 'ashby', 'workday') THEN {_S('posted_at')} ELSE '' END posted_at, CASE ats WHEN 'html' THEN 1 WHEN 'spa' THEN 2 ELSE 0 END source_tier
        FROM postings WHERE ats IS NOT NULL AND (ats <> 'html' OR {_STRIP('title')} <> '')""",
    "source_skipped": f"SELECT DISTINCT {_S('company')} company, 'skipped' status FROM postings WHERE ats IS NULL OR row_id % 10 = 0",
    "spa_normalise": f"SELECT sha1({_S('company')} || ':' || row_id) id, {_S('company')} company, {_S('title')} title, {_S('location')} AS location, {_S('url')} url, 2 source_tier FROM postings WHERE ats = 'spa'",
    "workday_pages": f"""SELECT sha1({_S('company')} || ':/job/' || seq) id, company, {_S('title')} title, {_S('location')} AS location, 'https://h.example/en-US/s/job/' || seq url, 'Posted Today' posted_at
        FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) n FROM jobs) WHERE n <= 2000""",
    "html_listing": f"""SELECT company, url, location, CASE WHEN rn <= 5 THEN 'about ' || title ELSE '' END description, 1 source_tier FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY row_id) rn FROM
        (SELECT row_id, company, 'https://c.example/j/' || row_id url, trim({_S('location')}) AS location, trim({_S('title')}) title FROM postings WHERE ats = 'html' AND company IS NOT NULL AND trim({_S('title')}) <> ''))""",
    "days_ago_bucket": """SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE CAST(d AS BIGINT) || 'd ago' END age, count(*) n_orders
        FROM (SELECT floor((epoch_ms(TIMESTAMP '1998-08-03 12:00:00') - epoch_ms(CAST(o_orderdate AS TIMESTAMP))) / 86400000.0) d FROM orders) GROUP BY 1""",
    "stream_first_seen": "SELECT DISTINCT id, 1 matched FROM job_arrivals WHERE id IS NOT NULL",
    "stream_streaks": """WITH r AS (SELECT * FROM run_log WHERE status <> 'skipped'), g AS (SELECT company, coalesce(max(CASE WHEN status <> 'error' THEN seq END), -1) good, max(seq) last_seq FROM r GROUP BY company)
        SELECT company, count(*) FILTER (status = 'error' AND seq > good) streak, any_value(last_seq) last_seq FROM r JOIN g USING (company) GROUP BY company""",
    "candidate_sources": f"""WITH f AS (SELECT company AS name, 0 source_rank, arrival_id pos FROM job_arrivals UNION ALL SELECT company, 1, doc_id FROM documents UNION ALL SELECT company, 2, row_id FROM postings)
        SELECT name, source_rank, pos FROM (SELECT DISTINCT ON (k) * FROM (SELECT *, {_NORM('name')} k FROM f WHERE name IS NOT NULL) WHERE k <> '' ORDER BY k, source_rank, pos) WHERE k NOT IN (SELECT {_NORM('name')} FROM companies)""",
    "discovery_summary": f"""WITH f AS (SELECT {_NORM('company')} k FROM postings WHERE company IS NOT NULL), n AS (SELECT count(DISTINCT k) c FROM f WHERE k <> '' AND k NOT IN (SELECT {_NORM('name')} FROM companies))
        SELECT count(*) "found", any_value(c) fresh, count(*) - any_value(c) dropped FROM f, n""",
    "page_commit": """WITH p AS (SELECT * FROM postings WHERE url IS NOT NULL AND url <> ''), o AS (SELECT DISTINCT ON (url) url, sha1(description) sha FROM p WHERE batch_no <= 15 ORDER BY url, row_id DESC),
        n AS (SELECT DISTINCT ON (url) url, sha1(description) sha, title FROM p WHERE batch_no > 15 ORDER BY url, row_id DESC), c AS (SELECT n.url, n.sha FROM n LEFT JOIN o USING (url) WHERE n.title IS NOT NULL AND n.sha IS NOT NULL AND n.sha IS DISTINCT FROM o.sha)
        SELECT url, sha body_sha1 FROM o WHERE url NOT IN (SELECT url FROM c) UNION ALL SELECT url, sha FROM c""",
    "postings_schema": "SELECT coalesce(source_tier, 0) source_tier, count(*) n, sum(length(substring(coalesce(description, ''), 1, 8000)))::BIGINT n_chars FROM postings GROUP BY 1",
    "run_outcomes": f"SELECT company, status, jobs_found FROM {_RUN}",
    "log_append": f"""SELECT seq, run_date, company, status, jobs_found, coalesce(error, '') error FROM run_log
        UNION ALL SELECT (SELECT max(seq) FROM run_log) + row_number() OVER (ORDER BY company), '2026-09-01T00:00:00+00:00', company, status, jobs_found, error FROM {_RUN}""",
    "stream_announced": "SELECT DISTINCT ON (id) id, company, title FROM job_arrivals WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL) ORDER BY id, arrival_id",
    "seed_mode": f"""SELECT true seed, count(*) n_new, 0 n_announced FROM {BATCH} UNION ALL SELECT false, count(*), count(*) FILTER (matched = 1) FROM {BATCH} WHERE id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)""",
    "request_gate": f"""WITH u AS (SELECT DISTINCT url FROM (SELECT url FROM postings WHERE url IS NOT NULL UNION ALL SELECT CASE company_id % 4 WHEN 0 THEN 'ftp://a.example/' WHEN 1 THEN 'https://user:pw@a.example/' WHEN 2 THEN 'http://10.0.0.8/' ELSE 'https://boards-api.greenhouse.io/v1/boards/' END || company_id FROM companies)),
        f AS (SELECT url, CASE WHEN lower({_part('url', 'scheme')}) NOT IN ('http', 'https') THEN 'scheme' WHEN contains({_part('url', 'authority')}, '@') THEN 'credentials' WHEN {_host('url')} = '' THEN 'host' WHEN starts_with({_host('url')}, '10.') THEN 'private' END why,
            {_host('url')} IN ({', '.join(_q(h) for h in urls.API_HOSTS)}) OR ends_with({_host('url')}, {_q(urls.API_SUFFIX)}) api, length({_part('url', 'authority')}) % 3 kind, {_part('url', 'path')} || CASE WHEN {_part('url', 'query')} <> '' THEN '?' || {_part('url', 'query')} ELSE '' END p FROM u),
        r(pattern, size, allow, kind) AS (VALUES ('^/openings/1', 11, false, 0), ('^/openings/1.*5$', 14, true, 0), ('^/.*\\?q=', 6, false, 0), ('^/', 1, false, 1), ('^/jobs', 5, true, 1)),
        d AS (SELECT url, any_value(why) why, any_value(api) api, any_value(f.kind) kind, coalesce(arg_max(allow, {{'s': size, 'a': allow}}), true) ok FROM f LEFT JOIN r ON r.kind = f.kind AND regexp_matches(CASE WHEN p = '' THEN '/' ELSE p END, pattern) GROUP BY url),
        e AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN NOT api AND NOT ok THEN 'robots' END reason FROM d)
        SELECT url, CASE WHEN reason IS NULL THEN 'fetch' ELSE 'blocked' END outcome, reason, CASE WHEN reason IS NULL THEN CASE WHEN NOT api AND kind = 0 THEN 2.0 ELSE 1.0 END END::DOUBLE AS "seconds" FROM e""",
    "resolve_cascade": f"""SELECT name, 'url' via, 0 AS rank, 'lever' ats, 't' || company_id token, 2 jobs_found FROM companies WHERE company_id % 5 = 0
        UNION ALL SELECT name, 'page', 0, 'ashby', 't' || company_id, 3 FROM companies WHERE company_id % 5 = 1 UNION ALL SELECT name, 'careers', 0, 'greenhouse', 't' || company_id, 1 FROM companies WHERE company_id % 5 = 2 AND company_id % 2 = 1
        UNION ALL SELECT name, 'name', 2, 'ashby', {_NORM('name')}, 7 FROM companies WHERE company_id % 5 > 2""",
    "infer_notes": """WITH v AS (SELECT company_id, ats, ats IN ('greenhouse', 'lever', 'ashby') AND company_id % 2 = 0 AND coalesce(token, '') <> '' good, repeat(name || '; ', 30) notes FROM companies)
        SELECT company_id, CASE WHEN good THEN 'LLM: ' || substring(notes, 1, 300) END evidence, CASE WHEN NOT coalesce(good, false) THEN coalesce(ats, 'None') || ': ' || substring(notes, 1, 200) END llm FROM v""",
    "infer_queue": "SELECT name, coalesce(careers_url, '') url, company_id pos FROM companies WHERE token IS NOT NULL ORDER BY company_id LIMIT 10",
    "jsearch_candidates": "SELECT company AS name, CASE WHEN seq % 2 = 0 THEN 'https://e.example/' || seq ELSE '' END url FROM run_log WHERE company <> ''",
    "jsearch_plan": "SELECT * FROM (VALUES (0, 'Software Engineer in London'), (1, 'Machine Learning Engineer in London')) v(pos, query)",
    "registry_valid": "SELECT ats, count(*) n FROM postings WHERE company <> '' AND ats <> '' GROUP BY ats",
    "board_tokens": "SELECT trim(token) AS name FROM companies WHERE trim(token) <> '' AND NOT starts_with(trim(token), '#')",
    "sitemap_seeds": f"""WITH h AS (SELECT DISTINCT lower({_part('url', 'authority')}) site FROM postings WHERE url IS NOT NULL AND url <> '')
        SELECT site, 'https://x.example/s.xml' url, 0 pos FROM h WHERE length(site) % 2 = 0 UNION ALL SELECT site, 'https://' || site || '/sitemap.xml', CASE WHEN length(site) % 2 = 0 THEN 1 ELSE 0 END FROM h""",
    "sitemap_zipped": "SELECT url FROM postings WHERE url <> '' AND NOT regexp_matches(url, '[<\\s]')",
    "api_jobs": """WITH h AS (SELECT * FROM jobs WHERE (title ILIKE '%engineer%' OR location ILIKE '%engineer%') AND matched = 1), g AS (SELECT * FROM h ORDER BY first_seen DESC NULLS LAST, posted_at DESC NULLS LAST, seq LIMIT 50 OFFSET 20)
        SELECT CAST(to_json({'total': (SELECT count(*) FROM h), 'jobs': coalesce((SELECT list({'company': company, 'title': title, 'location': location, 'url': url, 'posted_at': posted_at, 'first_seen': first_seen, 'matched': matched}
        ORDER BY first_seen DESC NULLS LAST, posted_at DESC NULLS LAST, seq) FROM g), [])}) AS VARCHAR) json""",
    "search_json": """SELECT CAST(to_json({'company': company, 'title': title, 'location': location, 'url': url, 'posted_at': posted_at, 'first_seen': first_seen, 'matched': matched}) AS VARCHAR) json
        FROM jobs WHERE company = 'Dektingirga Data Software' ORDER BY first_seen DESC NULLS LAST, posted_at DESC NULLS LAST, seq LIMIT 50""",
    "page_main": f"SELECT row_id, CASE WHEN {_STRIP('title')} <> '' THEN {_PLAIN('title')} || chr(10) ELSE '' END || regexp_replace('by ' || {_PLAIN('company')}, ' $', '') AS text FROM postings",
    "unescape_back": "SELECT row_id, description AS text FROM postings",
    "summary_input": f"SELECT row_id, {_LINE} line FROM postings WHERE {MATCHED} ORDER BY row_id LIMIT 50",
    "digest_chunks": f"""WITH l AS (SELECT company, row_id, {_LINE} line FROM postings WHERE {MATCHED} AND company IS NOT NULL), m AS (SELECT company, {_FOLDED} m FROM l GROUP BY company)
        SELECT company, CAST(generate_subscripts(m, 1) - 1 AS INT) part, unnest(m) message FROM m""",
}
_BOARD_OF = lambda c: f"""(SELECT row_id, CASE WHEN regexp_matches({c}, {_q(WORKDAY)}) THEN 'workday' {' '.join(f"WHEN len({_TOK(p).replace('body', c)}) > 0 THEN '{a}'" for a, p, _ in BOARDS)} END ats,
    CASE WHEN regexp_matches({c}, {_q(WORKDAY)}) THEN NULL {' '.join(f"WHEN len({_TOK(p).replace('body', c)}) > 0 THEN {_TOK(p).replace('body', c)}[1]" for a, p, _ in BOARDS)} END token,
    CASE WHEN regexp_matches({c}, {_q(WORKDAY)}) THEN regexp_extract({c}, {_q(WORKDAY)}, 1) END host, CASE WHEN regexp_matches({c}, {_q(WORKDAY)}) THEN regexp_extract({c}, {_q(WORKDAY)}, 2) END site FROM postings)"""  # noqa: E731
SQL |= {
    "posting_url_flags": f"""SELECT row_id, regexp_matches(lower({_part('url', 'path')}), {_q(chr(92) + '.(?:' + '|'.join(urls.BINARY_SUFFIXES) + ')$')}) is_binary,
        {_host('url')} IN ({', '.join(_q(h) for h in urls.API_HOSTS)}) OR ends_with({_host('url')}, {_q(urls.API_SUFFIX)}) is_api, regexp_matches({_part('url', 'path')}, {_q(CAREERS)}) is_careers FROM postings WHERE url IS NOT NULL""",
    "posting_url_policy": f"""SELECT row_id, CASE WHEN lower({_part('url', 'scheme')}) NOT IN ('http', 'https') THEN 'scheme' WHEN contains({_part('url', 'authority')}, '@') THEN 'credentials' WHEN {_host('url')} = '' THEN 'host' END reason FROM postings WHERE url IS NOT NULL""",
    "posting_boards": f"""SELECT u.row_id, coalesce(u.ats, d.ats) ats, CASE WHEN u.ats IS NULL THEN d.token ELSE u.token END token, CASE WHEN u.ats IS NULL THEN d.host ELSE u.host END host, CASE WHEN u.ats IS NULL THEN d.site ELSE u.site END site
        FROM {_BOARD_OF('url')} u JOIN {_BOARD_OF('description')} d USING (row_id)""",
    "infer_pages": "SELECT name, CASE WHEN careers_url IS NOT NULL THEN substring(repeat(careers_url || ' ', 2000), 1, 40000) END page FROM companies ORDER BY company_id LIMIT 20",
}
SQL["api_meta"] = f"""SELECT CAST(to_json({{'companies': (SELECT list({{'name': company, 'count': n}} ORDER BY company) FROM (SELECT company, count(*) n FROM jobs GROUP BY company)), 'total': (SELECT count(*) FROM jobs), 'matched': (SELECT coalesce(sum(matched), 0)::BIGINT FROM jobs),
    'last_run': (SELECT max(run_date) FROM run_log), 'alerts': coalesce((SELECT list(message ORDER BY company, message) FROM ({SQL['health_alerts']})), [])}}) AS VARCHAR) json"""
SQL["digest_whole"] = f"""WITH l AS (SELECT row_id, {_LINE} line FROM postings WHERE {MATCHED}), m AS (SELECT {_FOLDED} m FROM l HAVING count(*) > 0)
    SELECT CAST(generate_subscripts(m, 1) AS INT) part, unnest(m) message FROM m UNION ALL SELECT 0, '✨ New & fine'
    UNION ALL SELECT 1000000, '⚠️ <b>Health alerts</b>' || chr(10) || string_agg(e, chr(10) ORDER BY company, e) FROM (SELECT company, {_escaped('message')} e FROM ({SQL['health_alerts']})) HAVING count(*) > 0"""
