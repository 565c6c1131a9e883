"""Problem 3: the readings, against a plain Python version."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomlog.functions import instants
from loomlog.operators import timestamps

from .conftest import TESTDATA

UTC = dt.timezone.utc


def us(*a, micro=0, zone=UTC, minutes=None):
    t = dt.datetime(*a, tzinfo=dt.timezone(dt.timedelta(minutes=minutes)) if minutes is not None else zone)
    return round((t.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) / dt.timedelta(seconds=1)) * 1_000_000 + micro


BERLIN, NY = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [  # written, zone of the source, instant
    ("2026-01-31T10:20:30Z", None, us(2026, 1, 31, 10, 20, 30)),
    ("2026-01-31T10:20:30.123Z", "Asia/Tokyo", us(2026, 1, 31, 10, 20, 30, micro=123000)),
    (" \u00a02026-01-31T10:20:30Z\t", None, us(2026, 1, 31, 10, 20, 30)),
    ("2026-01-31T10:20:30.123456789Z", None, us(2026, 1, 31, 10, 20, 30, micro=123456)),
    ("2026-01-31 10:20:30,5", None, us(2026, 1, 31, 10, 20, 30, micro=500000)),
    ("2026-01-31 10:20:30.684z", None, us(2026, 1, 31, 10, 20, 30, micro=684000)),
    ("2026-01-31T10:20:30+12:45", None, us(2026, 1, 31, 10, 20, 30, minutes=765)),
    ("2026-01-31T10:20:30-0930", None, us(2026, 1, 31, 10, 20, 30, minutes=-570)),
    ("2026-01-31T10:20:30-05", None, us(2026, 1, 31, 10, 20, 30, minutes=-300)),
    ("2026-01-31T10:20:30.000-04:00[America/New_York]", None, us(2026, 1, 31, 10, 20, 30, minutes=-240)),
    ("2026-01-31 10:20:30 Europe/Berlin", "Asia/Tokyo", us(2026, 1, 31, 10, 20, 30, zone=BERLIN)),
    ("2026-01-31 10:20:30 PDT", None, us(2026, 1, 31, 10, 20, 30, minutes=-420)),
    ("2026-01-31 10:20:30 JST", None, us(2026, 1, 31, 10, 20, 30, minutes=540)),
    ("20260131T102030Z", None, us(2026, 1, 31, 10, 20, 30)),
    ("01/31/2026 10:20", "Europe/Berlin", us(2026, 1, 31, 10, 20, zone=BERLIN)),
    ("01/31/2026 12:05:06 AM", None, us(2026, 1, 31, 0, 5, 6)),
    ("01/31/2026 12:05:06 PM", None, us(2026, 1, 31, 12, 5, 6)),
    ("2026/01/31 10:20:30", "America/New_York", us(2026, 1, 31, 10, 20, 30, zone=NY)),
    ("Sat, 31 Jan 2026 10:20:30 +0530", None, us(2026, 1, 31, 10, 20, 30, minutes=330)),
    ("2026年1月31日 10:20:30", "Asia/Tokyo", us(2026, 1, 31, 1, 20, 30)),
    ("2026-01-31", "America/New_York", us(2026, 1, 31, zone=NY)),
    ("1769854830", None, 1769854830_000000),
    ("1769854830.714", None, 1769854830_714000),
    ("1769854830123", None, 1769854830_123000),
    ("1769854830123.4567", None, 1769854830_123456),
    ("1769854830123456", None, 1769854830_123456),
    ("2026-03-29T02:30:00", "Europe/Berlin", us(2026, 3, 29, 1, 30)),  # skipped: offset before, +01:00
    ("2025-10-26 02:30:00 Europe/Berlin", None, us(2025, 10, 26, 0, 30)),  # repeated: offset before, +02:00
    ("2025-11-02T01:30:00", "America/New_York", us(2025, 11, 2, 5, 30)),
    ("2024-02-29 00:00:00", None, us(2024, 2, 29)),
    ("1969-12-31T23:59:59.5Z", None, -500000),
    *[(v, None, None) for v in ["2026-02-29T00:00:00Z", "2026-13-01T00:00:00Z", "2026-01-31T24:00:00Z", "2026-01-31T10:60:00Z", "2026-01-31T10:20:60Z", "0000-00-00 00:00:00", "13/01/2026 10:00 ", "01/31/2026 13:00:00 PM", "n/a", "", "  ", "just now", "undated", "42", "2026-01-31T10:20:30 Nowhere/Town", None]],
    ("2026-01-31T10:20:30", "No/Zone", None),
]


def test_every_form(spark, zones):
    rows = spark.createDataFrame([(i, f"s{i}", w) for i, (w, _, _) in enumerate(CASES)], "id int, source_id string, w string")
    out = timestamps.with_instant(rows, "w", zones([(f"s{i}", z) for i, (_, z, _) in enumerate(CASES)])).collect()
    got = {r["id"]: r["instant_us"] for r in out}
    assert {i: (w, got[i]) for i, (w, _, _) in enumerate(CASES)} == {i: (w, x) for i, (w, _, x) in enumerate(CASES)}


def test_days_match_the_calendar(spark):
    days = spark.range(-800000, 400000, 997).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d"), "id")
    bad = days.filter(instants.days_from_civil(F.year("d").cast("bigint"), F.month("d").cast("bigint"), F.day("d").cast("bigint")) != F.col("id"))
    assert bad.count() == 0


def test_whole_table_against_python(spark):
    """All zoned, numeric and local forms of the table, by another implementation."""
    import re

    read = lambda t: spark.read.parquet(f"{TESTDATA}/{t}.parquet")
    zone = {r["source_id"]: r["zone_name"] or "UTC" for r in read("sources").collect()}
    values = [("claude_session", r["record_id"], r["source_id"], r["written_at"]) for r in read("claude_session").collect()] + [("hits", r["hit_id"], r["source_id"], r["hit_at"]) for r in read("hits").collect()]
    exp = set()
    fixed = {"JST": 9, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "UTC": 0}
    for table, key, source, w in values:
        if not w or re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?Z", w):
            continue
        v, at = w.strip(), None
        try:
            if re.fullmatch(r"\d+(\.\d+)?", v):
                digits = v.split(".")[0]
                at = round(float(v) * {10: 1e6, 13: 1e3, 16: 1}[len(digits)]) if len(digits) != 16 else int(v)
            else:
                m = re.fullmatch(r"(.*?)\[.*\]", v)
                v = (m[1] if m else v).replace(",", ".", 1) if not re.match("[A-Z]", v) else v
                tz = ZoneInfo(zone.get(source, "UTC"))
                if m2 := re.fullmatch(r"(.*\d) ([A-Z]{3,4})", v):
                    if m2[2] not in fixed and m2[2] not in ("AM", "PM"):
                        continue
                    if m2[2] in fixed:
                        v, tz = m2[1], dt.timezone(dt.timedelta(hours=fixed[m2[2]]))
                if m2 := re.fullmatch(r"(.*\d) ([A-Z]\w+/\w+)", v):
                    v, tz = m2[1], ZoneInfo(m2[2])
                t = None
                for form in ("%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S %z", "%Y年%m月%d日 %H:%M:%S", "%Y/%m/%d %H:%M:%S"):
                    try:
                        t = dt.datetime.strptime(v, form)
                        break
                    except ValueError:
                        pass
                t = t or dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", v.replace("z", "Z")))
                t = t if t.tzinfo else t.replace(tzinfo=tz)
                at = (t.astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)
        except (ValueError, KeyError):
            continue
        exp.add((table, key, at))
    got = timestamps.normalised(read("claude_session"), read("hits"), read("sources")).select("table_name", "row_key", "instant_us").collect()
    assert set(map(tuple, got)) == exp and len(got) == len(exp) > 100


@pytest.mark.parametrize("extra", ["", "instant_us long, zone_name string, written string"])
def test_empty_and_clashing(spark, session_rows, zones, extra):
    hits = spark.createDataFrame([], "hit_id long, source_id string, hit_at string, instant_us long")
    one = session_rows([{"record_id": 1, "written_at": "1769854830", "source_id": None}], extra)
    assert [tuple(r) for r in timestamps.normalised(one, hits, zones([])).select("row_key", "instant_us").collect()] == [(1, 1769854830_000000)]
    assert timestamps.normalised(session_rows([], extra), hits, zones([])).count() == 0


def test_many_sources_are_joined(spark, zones, monkeypatch):
    """What is broadcast for few sources is a shuffled join for many, with the same instants."""
    monkeypatch.setattr(timestamps, "is_small", lambda df: False)
    test_every_form(spark, zones)
