"""Dates and times in many notations, calendars and zones into one unambiguous form.

Parsing runs in Arrow batches, once per distinct value of a batch (as column expressions the same rules made
plans the optimizer did not finish): the text is split into date, time and zone, the date is read by its shape
and converted from its calendar by day-number arithmetic. Local times then meet zone-offset intervals: every
zone's offsets are exploded into intervals of local time, kept per zone and year, and joined as of the local
time. Two matching intervals mean the time occurred twice (ambiguous), none that it never occurred
(nonexistent), one gives the offset. The interval table has one row per zone and year, so the join moves no
large side. No year is out of its reach: before ``FIRST_YEAR`` no zone had changed its offset yet, after
``LAST_YEAR`` rules hold that give years of one kind (leap or not, same weekdays) the same changes.

Defined results: null and blank values yield no row; what states no real date or time (30 February,
25:00, a 13th month of 7 days, "unknown") is ``unreadable``; a calendar label that isn't known counts as
Gregorian; values without a day can't carry a time; a year or month alone is converted only where the
calendar's years and months are Gregorian ones (Buddhist era, Minguo), else it is ``unreadable``; so is a month
named in another calendar than the value's; a zone abbreviation means what it means in the jurisdiction's own
zone, if that uses it (IST, CST), else its most common zone; a value
without a known jurisdiction is read as Gregorian, day first; a local time without a known zone counts as UTC; repeated rows
yield one row.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names by calendar.
GREGORIAN_MONTHS = [
    ["january", "jan", "januar", "janvier", "enero", "มกราคม"],
    ["february", "feb", "februar", "février", "fevrier", "febrero", "กุมภาพันธ์"],
    ["march", "mar", "märz", "marz", "mars", "marzo", "มีนาคม"],
    ["april", "apr", "avril", "abril", "เมษายน"],
    ["may", "mai", "mayo", "พฤษภาคม"],
    ["june", "jun", "juni", "juin", "junio", "มิถุนายน"],
    ["july", "jul", "juli", "juillet", "julio", "กรกฎาคม"],
    ["august", "aug", "août", "aout", "agosto", "สิงหาคม"],
    ["september", "sep", "sept", "septembre", "septiembre", "กันยายน"],
    ["october", "oct", "oktober", "octobre", "octubre", "ตุลาคม"],
    ["november", "nov", "novembre", "noviembre", "พฤศจิกายน"],
    ["december", "dec", "dezember", "décembre", "decembre", "diciembre", "ธันวาคม"],
]
ETHIOPIAN_MONTHS = ["meskerem", "tikimt", "hidar", "tahsas", "tir", "yekatit", "megabit", "miazia", "ginbot", "sene", "hamle", "nehase", "pagume"]
SOLAR_MONTHS = ["hamal", "sawr", "jawza", "saratan", "asad", "sunbula", "mizan", "aqrab", "qaws", "jadi", "dalw", "hut"]
# Offsets in minutes of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "IST": 330, "JST": 540,
}
# Remainders by 33 of the leap years of the solar Hijri calendar.
SOLAR_LEAPS = (1, 5, 9, 13, 17, 22, 26, 30)

FIRST_YEAR, LAST_YEAR = 1840, 2128
# the last 28 years, all by rule: one of each of the 14 kinds of year, by the weekday of 1 January (Sunday first) and leap day
YEAR_OF_KIND = {(date(y, 1, 1).isoweekday() % 7) * 2 + (date(y, 12, 31).timetuple().tm_yday - 365): y for y in range(LAST_YEAR - 27, LAST_YEAR + 1)}


def _gregorian_days(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01 of a real date; None otherwise."""
    try:
        return date(y, m, d).toordinal() - 719163
    except ValueError:
        return None


def _ethiopian_days(y: int, m: int, d: int) -> int | None:
    size = 30 if m <= 12 else 6 if y % 4 == 3 else 5
    if y < 1 or not 1 <= m <= 13 or not 1 <= d <= size:
        return None
    return 1724221 + 365 * (y - 1) + y // 4 + 30 * (m - 1) + d - 1 - 2440588


def _solar_days(y: int, m: int, d: int) -> int | None:
    def leaps(n: int) -> int:
        """Leap years up to year n."""
        return n // 33 * len(SOLAR_LEAPS) + sum(n % 33 >= r for r in SOLAR_LEAPS)

    size = 31 if m <= 6 else 30 if m <= 11 or y % 33 in SOLAR_LEAPS else 29
    if y < 1 or not 1 <= m <= 12 or not 1 <= d <= size:
        return None
    new_year_1400 = 18707  # 2021-03-21
    passed = 365 * (y - 1400) + leaps(y - 1) - leaps(1399)
    return new_year_1400 + passed + (31 * (m - 1) if m <= 7 else 186 + 30 * (m - 7)) + d - 1


def calendar_of(label: Column) -> Column:
    """gregorian, buddhist, minguo, ethiopian or solar, from a label spelt in any way."""
    c = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(c.rlike("budd|thai"), "buddhist")
        .when(c.rlike("minguo|^ *r\\.?o\\.?c|republic"), "minguo")
        .when(c.rlike("ethiop"), "ethiopian")
        .when(c.rlike("solar|jalali|persian|shamsi|hijri"), "solar")
        .otherwise("gregorian")
    )


_WEEKDAY = re.compile(r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,? +")
_STAMP = re.compile(r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?=Z?$|[+-])")
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: Uhr| horas)?"
_ZONE = r"(?: ?([A-Z]{1,5}|[+-]\d{2}:?\d{2}))?(?:\[[^\]]*\])?"
_TIMED = re.compile(rf"^(.*?\S)(?:T|,? (?:um |à |a las )?){_CLOCK}{_ZONE}$")
_ERA = re.compile(r" (CE|C\.E\.|AD|E\.C\.)$")
_NAME = r"([^\d\s.,/-]+)"
# the shapes of a date with the meaning of their groups: o is a field set by the order of all-digit dates
_SHAPES = [
    (re.compile(p), fields)
    for p, fields in (
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "ymd"),
        (r"^(\d{4})(\d{2})(\d{2})$", "ymd"),
        (r"^(\d{1,3})[-/.](\d{1,2})[-/.](\d{4}|\d{1,2})$", "ooo"),
        (r"^(\d{4})-?(\d{3})$", "yn"),
        (r"^(\d{4})[-/](\d{1,2})$", "ym"),
        (r"^(\d{1,2})[-/.](\d{4})$", "my"),
        (r"^(\d{4})$", "y"),
        (rf"^(?:วันที่ )?(\d{{1,2}})(?:\.|er|st|nd|rd|th)?[ -](?:day of |de )?{_NAME}\.?,?[ -](?:de |B\.E\. |พ\.ศ\. ?)?(\d{{4}})$", "dNy"),
        (rf"^{_NAME}\.? (\d{{1,2}}),? (\d{{4}})$", "Ndy"),
        (rf"^(\d{{4}}) {_NAME} (\d{{1,2}})$", "yNd"),
        (r"^(?:中華民國|民國)? ?(\d{1,4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?日$", "ymd"),
        (rf"^{_NAME}\.? (?:de )?(\d{{4}})$", "Ny"),
    )
]
_MONTHS = {n: i for i, group in enumerate(GREGORIAN_MONTHS, 1) for n in group}
_MONTHS_OF = {"ethiopian": {n: i for i, n in enumerate(ETHIOPIAN_MONTHS, 1)}, "solar": {n: i for i, n in enumerate(SOLAR_MONTHS, 1)}}
BAD = ("bad", None, None, None, None, 0, None)


@lru_cache(1024)
def abbreviations(zone: str | None) -> dict[str, int]:
    """Offsets in minutes of zone abbreviations as understood in a zone; its latest meaning of each name holds."""
    own: dict[str, int] = {}
    if zone:
        try:
            rules = ZoneInfo(zone)
        except (KeyError, ValueError, OSError):
            return ABBREVIATIONS
        for year in range(1970, 2038):
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=rules)
                if at.tzname().isalpha():
                    own[at.tzname()] = round(at.utcoffset().total_seconds() / 60)
    return ABBREVIATIONS | own


def read_value(raw: str, calendar: str = "gregorian", order: str = "dmy", home: str | None = None) -> tuple:
    """``(kind, days, year, month, second of the day, microseconds, offset)`` of a stated date or time.

    The kind is year, month, day, time or bad; days are since 1970; the offset is in seconds, None if the
    time is local.
    """
    v = _WEEKDAY.sub("", " ".join("".join(str(unicodedata.digit(ch)) if ch.isdigit() and not ch.isascii() else ch for ch in raw).split()))
    if re.fullmatch(r"-?(\d{9,10}|\d{12,13})", v):
        ms = int(v) * (1000 if len(v.lstrip("-")) < 12 else 1)
        days, rest = divmod(ms, 86_400_000)
        return "time", days, None, None, rest // 1000, rest % 1000 * 1000, 0
    v = _STAMP.sub(r"\1-\2-\3T\4:\5:\6", v)
    timed = _TIMED.match(v)
    text, zone = (timed[1], timed[7]) if timed else (v, None)
    era = _ERA.search(text)
    text = _ERA.sub("", text)
    common = zone == "CE" or era is not None and era[1] != "E.C."
    offset = None
    if zone and zone != "CE":
        if zone[0] in "+-":
            digits = zone[1:].replace(":", "")
            offset = (int(digits[:2]) * 3600 + int(digits[2:]) * 60) * (-1 if zone[0] == "-" else 1)
        elif zone in (known := abbreviations(home)):
            offset = known[zone] * 60
        else:
            return BAD
    if common or offset is not None:
        calendar = "gregorian"
    elif "B.E." in text or "พ.ศ." in text:
        calendar = "buddhist"
    elif "民國" in text:
        calendar = "minguo"
    elif era:
        calendar = "ethiopian"
    for pattern, fields in _SHAPES:
        if hit := pattern.match(text):
            break
    else:
        return BAD
    groups = hit.groups()
    if fields == "ooo":
        leads = len(groups[0]) == 3 or order == "ymd" and len(groups[2]) < 3
        fields = "ymd" if leads else "mdy" if order == "mdy" else "dmy"
    got = dict(zip(fields, groups))
    if "N" in got and (named := _MONTHS_OF.get(calendar, _MONTHS).get(got["N"].lower())) is None:
        return BAD
    y = int(got["y"])
    if len(got["y"]) < 3 and calendar != "minguo":
        y += 2000
    y += -543 if calendar == "buddhist" else 1911 if calendar == "minguo" else 0
    civil = calendar in ("gregorian", "buddhist", "minguo")
    m = named if "N" in got else int(got["m"]) if "m" in got else None
    if "d" not in got and "n" not in got:
        if timed or not civil or not 1 <= y <= 9999 or m is not None and not 1 <= m <= 12:
            return BAD
        return "year" if m is None else "month", None, y, m, None, 0, None
    if "n" in got:
        new_year = _gregorian_days(y, 1, 1) if civil else None
        days = None if new_year is None else new_year + int(got["n"]) - 1
        if days is None or int(got["n"]) < 1 or days > _gregorian_days(y, 12, 31):
            return BAD
    else:
        to_days = {"ethiopian": _ethiopian_days, "solar": _solar_days}.get(calendar, _gregorian_days)
        if (days := to_days(y, m, int(got["d"]))) is None:
            return BAD
    if not timed:
        return "day", days, y, m, None, 0, None
    h, mi, s = int(timed[2]), int(timed[3]), int(timed[4] or 0)
    if timed[6]:
        if not 1 <= h <= 12:
            return BAD
        h = h % 12 + (12 if timed[6] in "Pp" else 0)
    if h > 23 or mi > 59 or s > 59:
        return BAD
    return "time", days, y, m, h * 3600 + mi * 60 + s, int((timed[5] or "").ljust(6, "0")[:6]), offset


PARSED = "p_kind string, p_days int, p_y int, p_m int, p_sec int, p_us int, p_off int"


def parse(df: DataFrame, raw: str, calendar: str, order: str, zone: str) -> DataFrame:
    """Adds the columns of PARSED, what ``read_value`` says of the text in ``raw``."""
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(PARSED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = lru_cache(1 << 16)(read_value)
        kinds = [pa.string()] + [pa.int32()] * 6
        names = [x.split()[0] for x in PARSED.split(", ")]
        for batch in batches:
            asked = pa.StructArray.from_arrays([batch.column(c).dictionary_encode().indices for c in (raw, calendar, order, zone)], list("abcd"))
            said = [batch.column(c).dictionary_encode().dictionary.to_pylist() + [None] for c in (raw, calendar, order, zone)]
            keys = list(zip(*(pc.fill_null(asked.field(c), -1).to_pylist() for c in "abcd")))
            distinct = {k: n for n, k in enumerate(dict.fromkeys(keys))}
            got = list(zip(*(memo(*(values[x] for values, x in zip(said, k))) for k in distinct))) or [()] * len(kinds)
            at = pa.array([distinct[k] for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(x, k).take(at) for x, k in zip(got, kinds)], batch.schema.names + names)

    return df.mapInArrow(run, schema)


def zone_intervals(zones: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """``(zone, year, spans)``: per zone and year the local-time intervals of each offset, as seconds since 1970.

    ``zones`` holds distinct zone names in column ``zone``; names of no zone yield nothing. One row per zone and
    year, so at most (zones of the time zone database, about 600) x (years) rows; computed on the executors.
    The offset at the start of the first year holds before it, that at the end of the last year after it.
    """

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, ever = available_timezones(), 1 << 50
        base = datetime(1970, 1, 1, tzinfo=timezone.utc)
        by_rule = int((datetime(2040, 1, 1, tzinfo=timezone.utc) - base).total_seconds())  # from here on two changes a year, or a month apart
        for frame in frames:
            out = []
            for name in frame["zone"]:
                if name not in known:
                    continue
                zone = ZoneInfo(name)
                offset = lambda t: int((base + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())  # noqa: B023, E731
                start = int((datetime(first - 1, 12, 1, tzinfo=timezone.utc) - base).total_seconds())
                stop = int((datetime(last + 1, 2, 1, tzinfo=timezone.utc) - base).total_seconds())
                spans, t, off, begun = [], start, offset(start), -ever
                while t < stop:
                    step = (4 if t < by_rule else 20) * 86400
                    if (new := offset(t + step)) != off:
                        lo, hi = t, t + step
                        while hi - lo > 1:
                            mid = (lo + hi) // 2
                            lo, hi = (lo, mid) if offset(mid) != off else (mid, hi)
                        spans.append((begun + off, hi + off, off))
                        begun, off, t = hi, offset(hi), hi
                        continue
                    off, t = new, t + step
                spans.append((begun + off, ever, off))
                los, his = [a for a, _, _ in spans], [b for _, b, _ in spans]
                for year in range(first, last + 1):
                    lo = int((datetime(year, 1, 1, tzinfo=timezone.utc) - base).total_seconds())
                    hi = int((datetime(year + 1, 1, 1, tzinfo=timezone.utc) - base).total_seconds()) if year < 9999 else stop
                    out.append((name, year, [{"lo": a, "hi": b, "off": o} for a, b, o in spans[bisect_right(his, lo) : bisect_left(los, hi)]]))
            yield pd.DataFrame(out, columns=["zone", "year", "spans"])

    # a tenth of a second a zone: spread over the cores
    return zones.repartition(zones.sparkSession.sparkContext.defaultParallelism, "zone").mapInPandas(explode, "zone string, year int, spans array<struct<lo:bigint,hi:bigint,off:int>>")


def normalise(values: DataFrame, raw: str, calendar: str, order: str, zone: str, zones: DataFrame) -> DataFrame:
    """Adds ``norm_value`` to rows whose ``raw`` is neither null nor blank; ``zones`` is made by ``zone_intervals``."""
    stated = parse(values.where(F.regexp_replace(raw, r"[\s ]+", "") != ""), raw, calendar, order, zone)
    p = lambda f: F.col(f"p_{f}")
    local = p("days").cast("bigint") * 86400 + p("sec")
    stated_year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), p("days")))
    new_year = F.make_date(stated_year, F.lit(1), F.lit(1))
    kind = (F.dayofweek(new_year) - 1) * 2 + F.dayofyear(F.make_date(stated_year, F.lit(12), F.lit(31))) - 365
    alike = F.element_at(F.array(*[F.lit(YEAR_OF_KIND[k]) for k in range(14)]), kind + 1)
    year = F.when(stated_year > LAST_YEAR, alike).otherwise(F.greatest(F.lit(FIRST_YEAR), stated_year))
    moved = F.when(stated_year > LAST_YEAR, F.datediff(new_year, F.make_date(alike, F.lit(1), F.lit(1)))).otherwise(0).cast("bigint")
    waits = (p("kind") == "time") & p("off").isNull()
    asked = stated.withColumns({"__local": local, "__zone": F.when(waits, F.col(zone)), "__year": F.when(waits, year), "__at": local - moved * 86400})
    spans = zones.select(F.col("zone").alias("__zone"), F.col("year").alias("__year"), F.col("spans").alias("__spans"))
    # proven small (see zone_intervals), and most rows wait for no zone: their null keys must not meet in one task
    met = asked.join(F.broadcast(spans), ["__zone", "__year"], "left")
    met = met.withColumn("__hits", F.filter("__spans", lambda s: (s["lo"] <= F.col("__at")) & (F.col("__at") < s["hi"])))
    utc = F.col("__local") - F.coalesce(p("off"), F.try_element_at("__hits", F.lit(1))["off"], F.lit(0))
    in_day = F.pmod(utc, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(utc / 86400).cast("int")).cast("string")
    stamp = F.format_string("%sT%02d:%02d:%02d.%06dZ", day, F.floor(in_day / 3600), F.floor(in_day % 3600 / 60), in_day % 60, p("us"))
    value = (
        F.when(p("kind") == "bad", "unreadable")
        .when(p("kind") == "year", F.lpad(p("y").cast("string"), 4, "0"))
        .when(p("kind") == "month", F.format_string("%04d-%02d", p("y"), p("m")))
        .when(p("kind") == "day", F.date_add(F.lit("1970-01-01").cast("date"), p("days")).cast("string"))
        .when(p("off").isNotNull() | F.col("__spans").isNull(), stamp)
        .when(F.size("__hits") > 1, "ambiguous")
        .when(F.size("__hits") == 1, stamp)
        .otherwise("nonexistent")
    )
    return met.withColumn("norm_value", value).drop("p_kind", "p_days", "p_y", "p_m", "p_sec", "p_us", "p_off", "__local", "__zone", "__year", "__at", "__spans", "__hits")


def found(descriptors: DataFrame, acquired: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """p4_found: one row per record with a stated date."""
    rules = jurisdictions.groupBy(F.col("code").alias("jurisdiction_code")).agg(
        F.first(calendar_of(F.col("calendar"))).alias("calendar"), F.first(F.try_element_at("extra", F.lit("timezone"))).alias("zone"), F.first(F.try_element_at("extra", F.lit("date_order"))).alias("date_order")
    )
    stated = descriptors.select(F.lit("descriptors").alias("source_table"), F.col("descriptor_id").alias("record_id"), "jurisdiction_code", F.col("raw_date").alias("raw")).unionByName(
        acquired.select(F.lit("acquired_documents").alias("source_table"), F.col("fetch_id").alias("record_id"), "jurisdiction_code", F.col("gazette_ref.date").alias("raw"))
    )
    known = stated.where("raw IS NOT NULL").join(rules, "jurisdiction_code", "left")
    known = known.withColumn("calendar", F.coalesce("calendar", F.lit("gregorian"))).withColumn("date_order", F.lower(F.coalesce("date_order", F.lit("dmy"))))
    zones = zone_intervals(rules.select("zone").where("zone IS NOT NULL").distinct())
    return normalise(known, "raw", "calendar", "date_order", "zone", zones).select("source_table", "record_id", "norm_value").distinct()
