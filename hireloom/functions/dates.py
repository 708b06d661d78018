"""Ages of postings. Operators never read the clock: the time that counts as now is always given."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:\.(\d{1,6})\d*)?)?(Z|[+-]\d{2}:?\d{2})?$"
AGO = r"(?i)posted\s+(?:(today)|(yesterday)|(\d+)\+?\s*days?\s*ago)"


def utc(as_of: datetime) -> Column:
    """A naive time as the UTC instant, whatever the session's zone."""
    return F.lit(as_of.isoformat(sep=" ") + "+00:00").cast("timestamp")


def posted_date(raw: Column, as_of: datetime) -> Column:
    """Epoch milliseconds, "posted N days ago" or an ISO date as a timestamp (no zone: UTC); null where it is none of them."""
    now = utc(as_of)
    get = lambda g: F.regexp_extract(raw, ISO, g)
    zone = F.when(get(5).isin("", "Z"), "+00:00").otherwise(F.regexp_replace(get(5), r"(\d{2}):?(\d{2})$", "$1:$2"))
    iso = F.concat(get(1), F.lit("T"), F.when(get(2) == "", "00:00").otherwise(get(2)), F.when(get(3) == "", ":00").otherwise(get(3)), F.lit("."), F.rpad(get(4), 6, "0"), zone)
    days = F.when(F.regexp_extract(raw, AGO, 1) != "", 0).when(F.regexp_extract(raw, AGO, 2) != "", 1).otherwise(F.regexp_extract(raw, AGO, 3).try_cast("int"))
    millis = raw.try_cast("bigint")
    return (
        F.when(raw.rlike(r"^[0-9]+$"), F.when(millis.between(0, 253402300799999), F.timestamp_millis(millis)))
        .when(raw.rlike(AGO), F.when(days <= 36500, F.timestamp_micros(F.unix_micros(now) - days.cast("bigint") * 86400000000)))
        .when(raw.rlike(ISO), iso.try_cast("timestamp"))
    )


def posted_recently(raw: Column, cap_days: int | None, as_of: datetime) -> Column:
    """Whether a posting is at most ``cap_days`` whole days old; unreadable dates and a cap of none or 0 pass, so do future dates."""
    if not cap_days:
        return F.lit(True)
    age = F.floor((F.unix_micros(utc(as_of)) - F.unix_micros(posted_date(raw, as_of))) / F.lit(86400000000))
    return F.coalesce(age <= cap_days, F.lit(True))


def days_ago(ts: Column, as_of: datetime) -> Column:
    """"today", "yesterday" or "Nd ago"."""
    days = F.floor((F.unix_millis(F.lit(as_of.isoformat(sep=" ")).cast("timestamp")) - F.unix_millis(ts)) / F.lit(86400000))
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit("d ago")))
