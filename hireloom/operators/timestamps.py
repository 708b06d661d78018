"""Mixed timestamp formats and zones normalised to one UTC instant (problem 2).

Raw strings repeat with their zone, so they are deduplicated into a dictionary of distinct (value, zone) pairs; each pair is
parsed once, by column expressions only, the result is appended to a dictionary table that later batches reuse, and the
instants are joined back to the rows. Relative values ("3 days ago") are dictionary entries too: they carry a distance, and
the row's own reference time turns it into an instant.
"""

from __future__ import annotations

import uuid
import zoneinfo
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.common import hot_rows, lookup, materialise, scratch_path

#: Instants outside these whole seconds, the years 2000 to 2100, are no case.
FIRST_S, LAST_S = 946684800, 4133980800

# Month names and their abbreviations in English, German, French and Spanish.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février févr fev febrero",
    3: "march mar märz mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre déc diciembre dic",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"(?:\s*\[?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5}|[A-Za-z_]+/[A-Za-z0-9_+/-]+|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?)\]?)?(?:\s*\([A-Za-z ]+\))?"
_NAME = r"(\p{L}{3,10})\.?"
_DAYNAME = r"(?:\p{L}{2,10}\.?,?\s+)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?)?"

#: (pattern, groups of year, month, day, hour, minute, second, am/pm, zone; 0: absent), tried in this order.
FORMATS: list[tuple[str, tuple[int, ...]]] = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]\s*|\s+){_TIME}{_ZONE}$", (1, 2, 3, 4, 5, 6, 0, 7)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3, 0, 0, 0, 0, 0)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt\s](\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,]\d+)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 0, 7)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3, 0, 0, 0, 0, 0)),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[Tt\s]+{_TIME}{_AMPM}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8)),
    (rf"^{_DAYNAME}(\d{{1,2}})\.\s*(\d{{1,2}})\.\s*(\d{{4}})(?:,?\s+(?:um\s+)?{_TIME}(?:\s*Uhr)?{_ZONE})?$", (3, 2, 1, 4, 5, 6, 0, 7)),
    (rf"^{_DAYNAME}(\d{{1,2}})(?:\.|st|nd|rd|th)?(?:\s+de)?[\s-]+{_NAME}(?:\s+de)?,?[\s-]+(\d{{4}})(?:,?\s+(?:um\s+|at\s+)?{_TIME}(?:\s*Uhr)?{_AMPM}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8)),
    (rf"^{_DAYNAME}{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_AMPM}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8)),
    (rf"^{_DAYNAME}{_NAME}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", (7, 1, 2, 3, 4, 5, 0, 6)),
]

_RELATIVE = r"(?i)^(?:posted\s+)?(?:(today|just now|just posted)|(yesterday)|(\d{1,4}|an?|one)\s+(day|hour)s?\s+ago)$"


@cache
def zone_table() -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) as each zone of the time-zone database writes it now; zone '' where all agree."""
    found, everywhere = {}, {}
    for name in sorted(zoneinfo.available_timezones()):
        if "/" not in name and name not in ("UTC", "GMT"):
            continue
        tz = zoneinfo.ZoneInfo(name)
        for month in (1, 7):
            at = datetime(2026, month, 1, tzinfo=timezone.utc).astimezone(tz)
            abbreviation, offset = at.tzname(), int(at.utcoffset().total_seconds())
            if abbreviation and abbreviation.isalpha():
                found[name, abbreviation.upper()] = offset
                everywhere.setdefault(abbreviation.upper(), set()).add(offset)
    found |= {("", a): next(iter(offsets)) for a, offsets in everywhere.items() if len(offsets) == 1}
    return tuple((z, a, o) for (z, a), o in sorted(found.items()))


def known_zones(spark: SparkSession) -> set[str]:
    """Zone names that both the JVM and the time-zone database know."""
    names = {n for n in zoneinfo.available_timezones()}
    try:
        return names & set(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:
        return names


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def parse_pairs(pairs: DataFrame) -> DataFrame:
    """(raw, zone, ...) -> the same with ``kind`` ('abs', 'rel' or null) and ``seconds``: the instant, or the distance into the past.

    Fractions round down. A value without zone is wall-clock time in ``zone`` and has no instant where that is null or unknown.
    An abbreviation has the offset it has in ``zone``; without a zone only abbreviations with one meaning world-wide count.
    A repeated local time is the first, a skipped one takes the offset before the change (the rules of java.time).
    """
    spark = pairs.sparkSession
    text = F.regexp_replace(F.regexp_replace(F.col("raw"), r"(?U)[\s​﻿]+", " "), r"^ | $", "")
    df = pairs.withColumn("_t", text)
    wall = None
    for pattern, groups in FORMATS:
        fields = "|".join(f"${g}" if g else "" for g in groups)
        this = F.regexp_replace("_t", pattern, fields)
        wall = F.when(F.col("_t").rlike(pattern), this) if wall is None else wall.when(F.col("_t").rlike(pattern), this)
    df = df.withColumn("_f", F.split(wall, r"\|"))
    field = lambda i: F.col("_f")[i]
    months = {word: m for m, words in MONTHS.items() for word in words.split()}
    number = field(1).rlike(r"^\d+$")
    month = F.when(number, field(1).try_cast("int")).otherwise(_lookup(months, F.lower(field(1))))
    hour = F.when(field(3) == "", F.lit(0)).otherwise(field(3).try_cast("int"))
    half = F.lower(field(6))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.when(field(4) == "", F.lit(0)).otherwise(field(4).try_cast("int"))
    second = F.when(field(5) == "", F.lit(0)).otherwise(field(5).try_cast("int"))
    leap = second == 60
    local = F.when(
        hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60),
        F.try_make_timestamp(field(0).try_cast("int"), month, field(2).try_cast("int"), hour, minute, F.least(second, F.lit(59)).cast("decimal(16,6)"), F.lit("UTC")),
    )
    df = df.withColumn("_local", local).withColumn("_leap", F.coalesce(leap.cast("int"), F.lit(0))).withColumn("_z", F.when(field(7) != "", field(7)))
    digits = F.regexp_replace(F.regexp_replace("_z", r"(?i)^(utc|gmt)", ""), r"[^0-9]", "")
    digits = F.when(F.length(digits) <= 2, F.concat(F.lpad(digits, 2, "0"), F.lit("00"))).otherwise(F.lpad(digits, 4, "0"))
    signed = F.col("_z").rlike(r"(?i)^(utc|gmt)?[+-]\d")
    offset = F.when(F.upper("_z").isin("Z", "UTC", "GMT"), F.lit(0)).when(
        signed & (F.substring(digits, 1, 2).try_cast("int") <= 18) & (F.substring(digits, 3, 2).try_cast("int") < 60),
        F.when(F.col("_z").contains("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60),
    )
    abbreviations = spark.createDataFrame([*zone_table()], "_az string, _aa string, _ao int")
    df = df.withColumn("_offset", offset)
    for place in ("zone", None):
        here = F.coalesce(F.col(place), F.lit("?")) if place else F.lit("")
        side = F.broadcast(abbreviations.withColumnRenamed("_ao", "_found"))
        df = df.join(side, (F.col("_az") == here) & (F.col("_aa") == F.upper("_z")), "left")
        wanted = F.col("_offset").isNull() if place else F.col("_offset").isNull() & F.col("zone").isNull()
        df = df.withColumn("_offset", F.when(wanted, F.col("_found")).otherwise(F.col("_offset"))).drop("_az", "_aa", "_found")
    names = known_zones(spark)
    region = F.when(F.col("_z").isNull(), F.col("zone")).when(F.col("_offset").isNull() & F.col("_z").contains("/"), F.col("_z"))
    zones = spark.createDataFrame([(n,) for n in sorted(names)], "_region string")
    df = df.withColumn("_want", region).join(F.broadcast(zones), F.col("_want") == F.col("_region"), "left")
    instant = F.when(F.col("_offset").isNotNull(), F.unix_seconds("_local") - F.col("_offset")).when(
        F.col("_region").isNotNull(), F.unix_seconds(F.to_utc_timestamp("_local", F.coalesce("_region", F.lit("UTC"))))
    )
    whole = F.when(F.col("_t").rlike(r"^\d{9,19}$"), F.col("_t").try_cast("bigint"))
    epoch = F.lit(None).cast("bigint")
    for unit in (1_000_000_000, 1_000_000, 1_000, 1):
        s = F.floor(whole / F.lit(unit)) if unit == 1 else whole.cast("decimal(20,0)") / F.lit(unit)
        s = F.floor(s).cast("bigint")
        epoch = F.coalesce(epoch, F.when(s.between(FIRST_S, LAST_S - 1), s))
    fraction = F.when(F.col("_t").rlike(r"^\d{9,10}\.\d+$"), F.regexp_extract("_t", r"^(\d+)", 1).try_cast("bigint"))
    absolute = F.coalesce(instant + F.col("_leap"), epoch, fraction)
    absolute = F.when(absolute.between(FIRST_S, LAST_S - 1), absolute)
    part = lambda g: F.regexp_extract("_t", _RELATIVE, g)
    count = F.when(part(3).rlike(r"^\d+$"), part(3).try_cast("bigint")).otherwise(F.lit(1))
    distance = F.when(
        F.col("_t").rlike(_RELATIVE),
        F.when(part(1) != "", 0).when(part(2) != "", 86400).otherwise(count * F.when(F.lower(part(4)) == "day", 86400).otherwise(3600)),
    ).cast("bigint")
    kind = F.when(absolute.isNotNull(), "abs").when(distance.isNotNull(), "rel")
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, kind.alias("kind"), F.coalesce(absolute, distance).alias("seconds"))


class TimestampDictionary:
    """The persisted dictionary: distinct (raw, zone) pairs with what they mean, one appended part per batch."""

    SCHEMA = "pair string, kind string, seconds bigint"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "timestamps")

    def parts(self) -> list[str]:
        """One folder for each batch; naming them keeps two readings at different times apart in one plan."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted(str(x.getPath().toString()) for x in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")))

    def known(self) -> DataFrame:
        parts = self.parts()
        return self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def extend(self, pairs: DataFrame) -> None:
        """Parses those of ``pairs`` (pair, raw, zone, each once) that are new, and appends them as one more part. A part counts once it
        is whole; one that was killed is left aside, and the pairs are simply appended again under another name."""
        parts = self.parts()
        fresh = pairs.join(self.known().select("pair"), "pair", "left_anti") if parts else pairs
        parse_pairs(fresh.select("pair", "raw", "zone")).select("pair", "kind", "seconds").write.parquet(f"{self.path}/batch-{len(parts):06d}-{uuid.uuid4().hex}")


def normalise(rows: DataFrame, raw: str, zone: str, reference: str | None, dictionary: TimestampDictionary, into: str = "epoch_s") -> DataFrame:
    """Adds ``into``: the instant of ``raw`` in whole seconds since 1970 UTC, rounded down, or null where it names none.

    ``zone`` names the column with the zone of a value without one; ``reference`` the timestamp column that relative values count
    back from (None: relative values have no instant). Nulls, empty values, bounds ("30+ days ago"), periods and
    impossible dates give null. Rows are never dropped, repeated rows stay; any other columns pass through.
    """
    usable = F.when(F.trim(raw) != "", F.col(raw))
    pair = F.concat(usable, F.lit("\x01"), F.coalesce(F.col(zone), F.lit("")))
    reference_s = F.unix_seconds(reference) if reference else F.lit(None).cast("bigint")
    # The row travels as one struct, so no column of its own can clash with those used here.
    keyed = rows.select(F.struct("*").alias("row"), pair.alias("_pair"), F.col(raw).alias("raw"), F.col(zone).alias("zone"), reference_s.alias("reference"))
    distinct = keyed.where(F.col("_pair").isNotNull()).groupBy(F.col("_pair").alias("pair")).agg(
        F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw"), F.first("zone").alias("zone")
    )
    distinct = materialise(distinct, "timestamp-pairs")
    dictionary.extend(distinct)
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = distinct.where(F.col("n") > hot_rows(total)).select("pair", "n")
    entries = dictionary.known().join(F.broadcast(hot), "pair", "left").select(F.col("pair").alias("_entry"), "kind", "seconds", F.coalesce("n", F.lit(1)).alias("n"))
    joined = lookup(keyed.select("row", "_pair", "reference"), entries, "_pair", "_entry", ["kind", "seconds"], "n", total)
    instant = F.when(F.col("kind") == "abs", F.col("seconds")).when(F.col("kind") == "rel", F.col("reference") - F.col("seconds"))
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c != into]
    return joined.select(*kept, F.when(instant.between(FIRST_S, LAST_S - 1), instant).alias(into))
