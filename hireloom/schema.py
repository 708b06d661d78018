"""Schemas of the central tables."""

POSTING = "id string, company string, title string, location string, url string, description string, posted_at string, source_tier int"
STATE = "id string, company string, title string, location string, url string, posted_at string, first_seen string, matched int"
RUN_LOG = "seq bigint, run_date string, company string, status string, jobs_found int, error string"
PAGE_CACHE = "url string, etag string, last_modified string, body_sha1 string, fetched_at string"
#: Characters that a description keeps.
DESCRIPTION_LIMIT = 8000
