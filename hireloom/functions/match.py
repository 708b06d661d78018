"""Filters compiled to column expressions once, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom.functions.dates import posted_recently

# Words in titles and descriptions that tell seniority, and the forms of required years.
SENIOR = r"(?iU)\b(?:senior|sr\.?|staff|principal|lead|director|manager|head|vp|architect)\b"
JUNIOR = r"(?iU)\b(?:intern|internship|junior|jr\.?|new grad|graduate|entry[- ]level)\b"
YEARS = r"(?iU)(\d{1,2})\s*(?:-|–|to)?\s*\d*\s*\+?\s*years?\b(?!\s*(?:ago|old))"
LEVEL = r"(?iU)\b(?:iii|iv|v|[lp]?[3-9])\b"
SHORTENED = (("machine learning", "ml"), ("artificial intelligence", "ai"))

#: A sign outside words, in the sense of Unicode, and the edges of a word.
_GAP, _BEFORE, _AFTER = r"[^\p{L}\p{N}_]", r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class Filters:
    roles: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    include_remote: bool = False
    experience: str = ""
    max_days_old: int | None = None


_LONG_FORMS = re.compile("|".join(re.escape(long) for long, _ in SHORTENED))


def shortened(text: str) -> str:
    """Lower case with the long forms of SHORTENED in their short ones; none of them overlaps another."""
    return _LONG_FORMS.sub(lambda m: dict(SHORTENED)[m.group()], text.lower())


def role_pattern(role: str) -> str:
    """The words of a role in order, at most one other word between two of them; a role without a-z or 0-9 matches any word."""
    words = re.findall("[a-z0-9]+", shortened(role))
    between = rf"{_GAP}+(?:[\p{{L}}\p{{N}}_]+{_GAP}+)?"
    return rf"{_BEFORE}{between.join(words)}{_AFTER}" if words else r"[\p{L}\p{N}_]"


def location_pattern(locations: tuple[str, ...]) -> str:
    return rf"(?i){_BEFORE}(?:{'|'.join(map(re.escape, locations))}){_AFTER}"


def title_ok(title: Column, roles: tuple[str, ...]) -> Column:
    if not roles:
        return F.lit(False)
    text = F.lower(title)
    for long, short in SHORTENED:
        text = F.replace(text, F.lit(long), F.lit(short))
    return F.coalesce(text.rlike("|".join(role_pattern(r) for r in roles)), F.lit(False))


def location_ok(location: Column, locations: tuple[str, ...], include_remote: bool) -> Column:
    bare = F.lower(F.regexp_replace(location, r"(?U)^\s+|\s+$", "")) == "remote"
    named = location.rlike(location_pattern(locations)) if locations else F.lit(False)
    return F.coalesce(named | bare if include_remote else named, F.lit(False))


def max_years(experience: str) -> int | None:
    """The last number of a wish such as "0-2 years"."""
    m = re.search(r"(\d+)\D*\Z", experience or "")
    return int(m[1]) if m else None


def experience_ok(title: Column, description: Column, cap: int | None) -> Column:
    """Ordered rules: no cap or a junior title passes; a senior title under a cap below 5, a level of three or more, or a number
    of required years above the cap in title or description fails; all else passes."""
    if cap is None:
        return F.lit(True)
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    over = lambda c: F.exists(F.regexp_extract_all(c, F.lit(YEARS), 1), lambda n: n.cast("int") > cap)
    rules = F.when(title.rlike(JUNIOR), True)
    if cap < 5:
        rules = rules.when(title.rlike(SENIOR), False)
    return rules.when(F.regexp_replace(title, YEARS, "").rlike(LEVEL), False).otherwise(~over(title) & ~over(description))


def matches(f: Filters, as_of: datetime) -> Column:
    """The whole predicate over title, location, description and posted_at, cheap conditions first."""
    return (
        title_ok(F.col("title"), f.roles)
        & location_ok(F.col("location"), f.locations, f.include_remote)
        & posted_recently(F.col("posted_at"), f.max_days_old, as_of)
        & experience_ok(F.col("title"), F.col("description"), max_years(f.experience))
    )
