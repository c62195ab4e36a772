from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lawlake.operators import timestamps as t

EPOCH = date(1970, 1, 1)


def day(raw, calendar="gregorian", order="dmy"):
    kind, days, y, m, *_ = t.read_value(raw, calendar, order)
    return {"day": lambda: str(EPOCH + timedelta(days)), "month": lambda: f"{y:04d}-{m:02d}", "year": lambda: f"{y:04d}"}.get(kind, lambda: kind)()


@pytest.mark.parametrize(
    ("raw", "calendar", "order", "said"),
    [
        ("2011-09-02", "gregorian", "mdy", "2011-09-02"), ("04/14/2020", "gregorian", "mdy", "2020-04-14"), ("03/04/2020", "gregorian", "dmy", "2020-04-03"),
        ("16.7.21", "gregorian", "dmy", "2021-07-16"), ("20090609", "gregorian", "dmy", "2009-06-09"), ("2014-028", "gregorian", "dmy", "2014-01-28"),
        ("2023-366", "gregorian", "dmy", "bad"), ("2024-366", "gregorian", "dmy", "2024-12-31"), ("03/2021", "gregorian", "dmy", "2021-03"), ("2017-06", "gregorian", "dmy", "2017-06"),
        ("2021", "gregorian", "dmy", "2021"), ("28th day of April 2011", "gregorian", "dmy", "2011-04-28"), ("1er août 2019", "gregorian", "dmy", "2019-08-01"),
        ("14 de enero de 2020", "gregorian", "dmy", "2020-01-14"), ("19. September 2022", "gregorian", "dmy", "2022-09-19"), ("31-Jan-2022", "gregorian", "dmy", "2022-01-31"),
        ("September 17, 2021", "gregorian", "mdy", "2021-09-17"), ("วันที่ ๑๗ ธันวาคม พ.ศ. ๒๕๖๗", "buddhist", "dmy", "2024-12-17"), ("27 September B.E. 2565", "buddhist", "dmy", "2022-09-27"),
        ("20-07-2558", "buddhist", "dmy", "2015-07-20"), ("20 September 2016 CE", "buddhist", "dmy", "2016-09-20"), ("民國110年8月27日", "minguo", "ymd", "2021-08-27"),
        ("中華民國 98 年 5 月 1 日", "minguo", "ymd", "2009-05-01"), ("98.11.20", "minguo", "ymd", "2009-11-20"), ("098/09/30", "minguo", "ymd", "2009-09-30"),
        ("Meskerem 1, 2000", "ethiopian", "dmy", "2007-09-12"), ("6 Pagume 2011 E.C.", "ethiopian", "dmy", "2019-09-11"), ("6 Pagume 2012 E.C.", "ethiopian", "dmy", "bad"),
        ("1400 Hamal 1", "solar", "ymd", "2021-03-21"), ("1399 Hut 30", "solar", "ymd", "2021-03-20"), ("1400-12-30", "solar", "ymd", "bad"), ("1403-12-30", "solar", "ymd", "2025-03-20"),
        ("30 February 2016", "gregorian", "dmy", "bad"), ("2022-00-10", "gregorian", "dmy", "bad"), ("unknown", "gregorian", "dmy", "bad"), ("—", "gregorian", "dmy", "bad"), ("s.d.", "gregorian", "dmy", "bad"),
        ("0000-00-00", "gregorian", "dmy", "bad"), ("99999999", "gregorian", "dmy", "bad"), ("1388", "solar", "ymd", "bad"),
        ("30 February 2016", "ethiopian", "dmy", "bad"), ("30 February 2016", "solar", "ymd", "bad"), ("3 March 2016", "ethiopian", "dmy", "bad"), ("3 March 2016 CE", "solar", "ymd", "2016-03-03"), ("Hamal 1, 2000", "gregorian", "dmy", "bad"),
    ],
)
def test_dates(raw, calendar, order, said):
    assert day(raw, calendar, order) == said


@given(st.dates(date(1600, 1, 1), date(2600, 1, 1)))
def test_gregorian_round_trip(d):
    assert day(d.isoformat()) == d.isoformat()


@given(st.integers(1, 3000), st.integers(1, 13), st.integers(1, 30))
def test_ethiopian_days_are_consecutive(y, m, d):
    here, size = t._ethiopian_days(y, m, d), 30 if m < 13 else 5 + (y % 4 == 3)
    following = (y, m, d + 1) if d < size else (y, m + 1, 1) if m < 13 else (y + 1, 1, 1)
    if d <= size:
        assert t._ethiopian_days(*following) == here + 1


@given(st.integers(1, 1500), st.integers(1, 12), st.integers(1, 31))
def test_solar_days_are_consecutive(y, m, d):
    size = 31 if m <= 6 else 30 if m <= 11 or y % 33 in t.SOLAR_LEAPS else 29
    following = (y, m, d + 1) if d < size else (y, m + 1, 1) if m < 12 else (y + 1, 1, 1)
    if d <= size:
        assert t._solar_days(*following) == t._solar_days(y, m, d) + 1


CASES = [
    ("2019-10-27 02:04:51", "Europe/Berlin", "ambiguous"), ("2011-03-27T02:34", "Europe/Madrid", "nonexistent"), ("2017-11-17 21:57:26 CET", "Europe/Paris", "2017-11-17T20:57:26.000000Z"),
    ("2021-01-23 06:41:13,902", "Asia/Kolkata", "2021-01-23T01:11:13.902000Z"), ("Nov 15, 2020 6:27:25 AM", "America/New_York", "2020-11-15T11:27:25.000000Z"),
    ("Apr 9, 2019 12:50 PM", "Australia/Sydney", "2019-04-09T02:50:00.000000Z"), ("Tue, 06 Jul 2010 07:00:51 +0430", "Asia/Kabul", "2010-07-06T02:30:51.000000Z"),
    ("2024-04-27T22:06:49+02:00[Europe/Madrid]", "Europe/Madrid", "2024-04-27T20:06:49.000000Z"), ("1414283401", "Europe/Paris", "2014-10-26T00:30:01.000000Z"),
    ("1351301471353", "Europe/Paris", "2012-10-27T01:31:11.353000Z"), ("20101025T064725Z", "Asia/Taipei", "2010-10-25T06:47:25.000000Z"), ("30. Oktober 2011 um 02:39 Uhr", "Europe/Berlin", "ambiguous"),
    ("24 de febrero de 2011 a las 07:08 horas", "Europe/Madrid", "2011-02-24T06:08:00.000000Z"), ("23 novembre 2024 à 06h17", "Europe/Paris", "2024-11-23T05:17:00.000000Z"),
    ("2020-01-01 25:00:00", "Europe/Paris", "unreadable"), ("2020-01-01 10:00:00 QQQ", "Europe/Paris", "unreadable"), (" 2016-11-10", "Europe/Paris", "2016-11-10"), ("2014-05-29T10:05", None, "2014-05-29T10:05:00.000000Z"),
    ("Mars 3000", "Europe/Paris", "3000-03"), ("2300-07-01 10:00", "Europe/Paris", "2300-07-01T08:00:00.000000Z"), ("2150-07-01 12:00", "Europe/Berlin", "2150-07-01T10:00:00.000000Z"),
    ("1890-06-01 12:00", "Europe/Berlin", "1890-06-01T11:06:32.000000Z"), ("1500-06-01 12:00", "Europe/Berlin", "1500-06-01T11:06:32.000000Z"), ("9998-07-01 12:00", "Europe/Berlin", "9998-07-01T10:00:00.000000Z"), ("9998-12-01 12:00", "Europe/Berlin", "9998-12-01T11:00:00.000000Z"),
    ("2020-05-01 12:00 IST", "Asia/Kolkata", "2020-05-01T06:30:00.000000Z"), ("2020-05-01 12:00 IST", "Asia/Jerusalem", "2020-05-01T10:00:00.000000Z"), ("2020-05-01 12:00 CST", "Asia/Taipei", "2020-05-01T04:00:00.000000Z"), ("2020-05-01 12:00 CST", "America/Chicago", "2020-05-01T18:00:00.000000Z"), ("1700-01-01 10:00:00", "Not/AZone", "1700-01-01T10:00:00.000000Z"), ("x" * 100_000, "Europe/Paris", "unreadable"),
]


def test_times_meet_zone_intervals(spark):
    rows = [(i, raw, "gregorian", "dmy", zone) for i, (raw, zone, _) in enumerate(CASES)] + [(98, "  ", "gregorian", "dmy", "UTC"), (99, None, "gregorian", "dmy", "UTC")]
    df = spark.createDataFrame(rows, "i int, raw string, calendar string, ord string, tz string")
    zones = t.zone_intervals(spark.createDataFrame([(z,) for z in sorted({z for _, z, _ in CASES if z})], "zone string"))
    got = {r.i: r.norm_value for r in t.normalise(df, "raw", "calendar", "ord", "tz", zones).collect()}
    assert {i for i, v in got.items() if v is None} == set()
    assert {i: got[i] for i, (_, _, said) in enumerate(CASES) if said} == {i: said for i, (_, _, said) in enumerate(CASES) if said}


def test_intervals_agree_with_zone_rules(spark):
    spans = t.zone_intervals(spark.createDataFrame([("America/Chicago",)], "zone string"), 2010, 2012).collect()
    zone = ZoneInfo("America/Chicago")
    for r in spans:
        for k in range(0, 366 * 24, 7):
            local = datetime(r.year, 1, 1) + timedelta(hours=k)
            sec = int((local - datetime(1970, 1, 1)).total_seconds())
            hits = {s["off"] for s in r.spans if s["lo"] <= sec < s["hi"]}
            want = {int(o.total_seconds()) for f in (0, 1) if (x := local.replace(tzinfo=zone, fold=f)).astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None) == local for o in [x.utcoffset()]}
            if local.year == r.year:
                assert hits == want, local


def test_whole_query_on_dirt(spark):
    d = spark.createDataFrame([(1, "xx", "2020-01-01", 0), (1, "xx", "2020-01-01", 0), (2, None, None, 0), (3, "xb", "27/10/2019 02:30", 0)], "descriptor_id bigint, jurisdiction_code string, raw_date string, p_kind int")
    a = spark.createDataFrame([], "fetch_id bigint, jurisdiction_code string, gazette_ref struct<date:string>")
    j = spark.createDataFrame([("xb", "Gregorian", {"timezone": "Europe/Berlin", "date_order": "dmy"}), ("xq", None, None)], "code string, calendar string, extra map<string,string>")
    assert sorted(map(tuple, t.found(d, a, j).collect())) == [("descriptors", 1, "2020-01-01"), ("descriptors", 3, "ambiguous")]
