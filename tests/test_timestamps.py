from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from hireloom.operators.timestamps import TimestampDictionary, normalise, parse_pairs

SCHEMA = "k bigint, raw string, zone string, at timestamp, kind string, seconds string, _pair int"
AT = datetime(2026, 8, 20, 3, 0, 5)


def at(y, mo, d, h=0, mi=0, s=0, zone="UTC"):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=ZoneInfo(zone)).timestamp())


CASES = [
    ("2026-07-14T03:52:24-04:00", None, at(2026, 7, 14, 7, 52, 24)),
    ("2026-07-14t03:52:24z ", None, at(2026, 7, 14, 3, 52, 24)),
    ("2026-07-14T03:52:24.999999999Z", "Asia/Tokyo", at(2026, 7, 14, 3, 52, 24)),
    ("2026-07-14 03:52", "Europe/Berlin", at(2026, 7, 14, 1, 52)),
    ("2026-07-14 03:52", None, None),
    ("2026-07-14", "America/New_York", at(2026, 7, 14, 4)),
    ("2025-11-02T01:30:00", "America/New_York", at(2025, 11, 2, 5, 30)),  # twice: the first
    ("2026-03-08T02:30:00", "America/New_York", at(2026, 3, 8, 7, 30)),  # skipped: the offset before
    ("2025-11-02T01:30:00 America/New_York", "Asia/Tokyo", at(2025, 11, 2, 5, 30)),
    ("2026-06-12T05:17:11[Europe/Paris]", None, at(2026, 6, 12, 3, 17, 11)),
    ("2026-07-20 22:44:27+0530", None, at(2026, 7, 20, 17, 14, 27)),
    ("2026-02-28 17:05:54 EST", "America/New_York", at(2026, 2, 28, 22, 5, 54)),
    ("2026-04-15 15:36:23 IST", "Asia/Kolkata", at(2026, 4, 15, 10, 6, 23)),
    ("2026-04-15 15:36:23 IST", "Europe/Dublin", at(2026, 4, 15, 14, 36, 23)),
    ("2026-04-15 15:36:23 IST", None, None),
    ("2026-06-08 20:22:47 CEST", None, at(2026, 6, 8, 18, 22, 47)),
    ("20260808T091405Z", None, at(2026, 8, 8, 9, 14, 5)),
    ("20260611 0157", "Asia/Kolkata", at(2026, 6, 10, 20, 27)),
    ("1784991947", None, 1784991947),
    ("1784642419547", None, 1784642419),
    ("1787489862619747", None, 1787489862),
    ("Tue, 21 Jul 2026 01:06:01 +0100", None, at(2026, 7, 21, 0, 6, 1)),
    ("Mon, 04 May 2026 16:37:06 GMT", None, at(2026, 5, 4, 16, 37, 6)),
    ("05/31/2026 4:20 AM", "UTC", at(2026, 5, 31, 4, 20)),
    ("05/31/2026 12:20 AM", "UTC", at(2026, 5, 31, 0, 20)),
    ("28.05.2026 13:00", "UTC", at(2026, 5, 28, 13)),
    ("25. Juli 2026, 00:47 Uhr", "Europe/Berlin", at(2026, 7, 24, 22, 47)),
    ("4. März 2026, 10:00 Uhr", "UTC", at(2026, 3, 4, 10)),
    ("Aug 28, 2026", "UTC", at(2026, 8, 28)),
    ("Jun 21, 2026 3:10 PM CEST", "Europe/Berlin", at(2026, 6, 21, 13, 10)),
    ("19 July 2026, 09:43", "UTC", at(2026, 7, 19, 9, 43)),
    ("posted 26 days ago", None, int((AT.replace(tzinfo=timezone.utc) - timedelta(days=26)).timestamp())),
    ("18 hours ago", None, int((AT.replace(tzinfo=timezone.utc) - timedelta(hours=18)).timestamp())),
    ("Posted Yesterday", None, int((AT.replace(tzinfo=timezone.utc) - timedelta(days=1)).timestamp())),
    ("posted today", None, int(AT.replace(tzinfo=timezone.utc).timestamp())),
] + [(x, "UTC", None) for x in ("", " ", None, "0", "-1", "99999999999999999999", "Posted 30+ Days Ago", "more than a month ago", "2026-W18", "Q2 2026", "March 2026", "05:30", "ASAP", "0000-00-00", "2026-02-30T10:00:00Z", "1999-12-31T23:59:59Z", "2101-01-01", "25:99", "2026-07-14T03:52:24 Mars/Base", "x" * 100_000)]


def test_every_form(spark):
    rows = [(i, raw, zone, AT, "own", "own", 7) for i, (raw, zone, _) in enumerate(CASES)]
    got = normalise(spark.createDataFrame(rows * 2, SCHEMA), "raw", "zone", "at", TimestampDictionary(spark))
    assert got.columns == ["k", "raw", "zone", "at", "kind", "seconds", "_pair", "epoch_s"]  # clashing names pass through
    found = got.collect()
    assert len(found) == 2 * len(CASES)  # repeated rows stay
    for r in found:
        assert r["epoch_s"] == CASES[r["k"]][2], CASES[r["k"]]
        assert (r["kind"], r["seconds"], r["_pair"]) == ("own", "own", 7)


def test_dictionary_is_kept_and_reused(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    rows = spark.createDataFrame([(1, "2026-07-14", "UTC", AT, "", "", 1)], SCHEMA)
    more = spark.createDataFrame([(1, "2026-07-14", "UTC", AT, "", "", 1), (2, "2026-07-15", "UTC", AT, "", "", 1)], SCHEMA)
    normalise(rows, "raw", "zone", None, TimestampDictionary(spark, path)).collect()
    again = TimestampDictionary(spark, path)
    assert again.known().count() == 1
    assert sorted(r["epoch_s"] for r in normalise(more, "raw", "zone", None, again).collect()) == [at(2026, 7, 14), at(2026, 7, 15)]
    assert [spark.read.parquet(p).count() for p in again.parts()] == [1, 1]  # only the new value was parsed again


def test_empty_table(spark):
    assert normalise(spark.createDataFrame([], SCHEMA), "raw", "zone", "at", TimestampDictionary(spark)).collect() == []


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.datetimes(datetime(2000, 1, 2), datetime(2100, 12, 30)), st.sampled_from(["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "UTC"])), min_size=20, max_size=60))
def test_wall_clock_as_the_zone_database_reads_it(spark, values):
    rows = [(f"{i}", v.strftime("%Y-%m-%d %H:%M:%S"), z) for i, (v, z) in enumerate(values)]
    got = {r["pair"]: r["seconds"] for r in parse_pairs(spark.createDataFrame(rows, "pair string, raw string, zone string")).collect()}
    for (key, _, z), (v, _) in zip(rows, values):
        assert got[key] == int(v.replace(microsecond=0, tzinfo=ZoneInfo(z), fold=0).timestamp())


def test_long_values_and_killed_appends(spark, tmp_path):
    padded = "2026-03-01T10:00:00Z" + " " * 400
    df = spark.createDataFrame([(1, padded, None), (2, "x" * 5000, None)], "k int, raw string, zone string")
    dictionary = TimestampDictionary(spark, f"file://{tmp_path}/dictionary")
    got = {r["k"]: r["epoch_s"] for r in normalise(df, "raw", "zone", None, dictionary).collect()}
    assert got == {1: 1772359200, 2: None}
    (tmp_path / "dictionary" / "batch-000001-dead").mkdir()  # an append that was killed
    more = spark.createDataFrame([(3, "2026-03-02", "UTC")], "k int, raw string, zone string")
    for _ in range(2):
        assert normalise(more, "raw", "zone", None, dictionary).first()["epoch_s"] == 1772409600
    assert len(dictionary.parts()) == 3
