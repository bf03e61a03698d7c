"""Date-time parsing and bucketing (Column -> Column).

Every layout is rewritten to one ISO shape plus an explicit offset, so one cast and
one subtraction give the UTC time. Nothing here reads the session time zone.
"""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.memo import memo
from loglake.functions.text import let, trim_space

# English month names, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_CLOCK = r"(\d{1,2})(:\d{2}:\d{2})"
_FRACTION = r"(?:[.,](\d+))?"
_MONTH = r"([A-Za-z]{3})"
_WEEKDAY = r"(?i:mon|tue|wed|thu|fri|sat|sun)"
_ZONE = r"(GMT[+-]\d{1,2}(?::\d{2})?|[A-Z]{3}|[A-Z]{3,4}T|WITA|ChST|MeST)"

# Fixed patterns: the accepted layouts, whole text, in the order they are tried. Next to
# each stands which groups are year, month, day, hour, minutes and seconds, fraction,
# AM/PM and zone (0: the layout has none).
LAYOUTS = (
    # 2016-03-16 GMT-3 19:45:41
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}}) +(GMT[+-]\d{{1,2}})\S* +{_CLOCK}{_FRACTION}", (1, 2, 3, 5, 6, 7, 0, 4)),
    # 2019-05-31T14:52:53.818309-04:00
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})T{_CLOCK}{_FRACTION}([+-]\d{{2}}:\d{{2}})", (1, 2, 3, 4, 5, 6, 0, 7)),
    # 16/May/2018:18:34:08 +0400
    (rf"(\d{{2}})/{_MONTH}/(\d{{4}}):{_CLOCK}{_FRACTION} +([+-]\d{{4}})", (3, 2, 1, 4, 5, 6, 0, 7)),
    # 2012-03-28 16:15:40,637
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}}) +{_CLOCK},(\d{{3}})", (1, 2, 3, 4, 5, 6, 0, 0)),
    # May 16, 2018 6:26:25 PM, with or without a zone
    (rf"{_MONTH} +(\d{{1,2}}), +(\d{{4}}) +{_CLOCK}{_FRACTION} +(AM|PM)(?: +{_ZONE})?", (3, 1, 2, 4, 5, 6, 7, 8)),
    # May 16, 2018 16:28:57 MSK
    (rf"{_MONTH} +(\d{{1,2}}), +(\d{{4}}) +{_CLOCK}{_FRACTION} +{_ZONE}", (3, 1, 2, 4, 5, 6, 0, 7)),
    # Wed Mar 28 16:17:29 GMT-4 2012
    (rf"{_WEEKDAY} +{_MONTH} +(\d{{1,2}}) +{_CLOCK}{_FRACTION} +{_ZONE} +(\d{{4}})", (7, 1, 2, 3, 4, 5, 0, 6)),
)
ANY_DATE = r"(?<![0-9A-Za-z])(?:" + "|".join(pattern for pattern, _ in LAYOUTS) + r")(?![0-9A-Za-z])"


def resolve_zone(name: str | None) -> str:
    """Check a zone name once on the driver; an unknown name means UTC."""
    try:
        return ZoneInfo(name).key if name else "UTC"
    except Exception:
        return "UTC"


def _month_number(name: Column) -> Column:
    """Two digits of a month name; anything else stays as it is."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)


def _date_parts(s: Column) -> Column:
    """Year, month, day, hour, minutes and seconds, fraction, AM/PM, zone: one per line."""
    branches = F
    for pattern, order in LAYOUTS:
        replacement = "\n".join(f"${group}" if group else "" for group in order)
        branches = branches.when(s.rlike(rf"^(?:{pattern})\z"), F.regexp_replace(s, rf"^(?:{pattern})\z", replacement))
    return F.split(branches.otherwise(F.lit(None)), "\n")


def _local_time(p: Column) -> Column:
    """The time as written, without its zone; NULL for a date that does not exist."""
    hour = p[3].cast("int")
    clock12 = F.when(hour <= 12, (hour % 12 + F.when(p[6] == "PM", 12).otherwise(0)).cast("string"))
    two = [F.lpad(x, 2, "0") for x in (p[2], F.when(p[6] == "", p[3]).otherwise(clock12))]
    text = F.concat(p[0], F.lit("-"), _month_number(p[1]), F.lit("-"), two[0], F.lit(" "), two[1], p[4], F.lit("."), p[5])
    return text.try_cast("timestamp_ntz")


def _zone_digits(zone: Column) -> Column:
    return F.replace(F.replace(zone, F.lit("GMT"), F.lit("")), F.lit(":"), F.lit(""))


def _offset_of(digits: Column) -> Column:
    """``+3``, ``-0330`` or ``+0400`` as ``+03:00``; NULL for an abbreviation or none."""
    short = F.length(digits) % 2 == 0  # a sign and one hour digit, or with two minute digits
    filled = F.when(short, F.concat(F.substring(digits, 1, 1), F.lit("0"), F.substring(digits, 2, 3))).otherwise(digits)
    minutes = F.rpad(F.substring(filled, 4, 2), 2, "0")
    signed = F.substring(digits, 1, 1).isin("+", "-")
    return F.when(signed, F.concat(F.substring(filled, 1, 3), F.lit(":"), minutes))


def shift_to_utc(local: Column, offset: Column) -> Column:
    """Subtract a ``+hh:mm`` offset from a local time."""
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int"))
    return local - F.make_dt_interval(mins=minutes)


def format_offset(offset: Column) -> Column:
    """A zero offset prints as ``Z``."""
    return F.when(F.substring(offset, 2, 5) == "00:00", "Z").otherwise(offset)


def _resolved(local: Column, offset: Column, s: Column, zone: str) -> dict[str, Column]:
    explicit = offset.isNotNull()
    inferred = local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    # the layout with the offset after the day prints a zero offset in digits
    shown = F.when(F.substring(s, 11, 1) == " ", offset).otherwise(format_offset(offset))
    return {
        "ts": F.when(explicit, shift_to_utc(local, offset)).otherwise(inferred),
        "ts_raw": s,
        "tz_offset": F.when(local.isNotNull() & explicit, shown).otherwise(""),
        "tz_inferred": local.isNotNull() & ~explicit,
    }


def parse_datetime(text: Column, default_tz: str = "UTC") -> Column:
    """Struct (ts, ts_raw, tz_offset, tz_inferred) of a date-time text.

    An explicit offset gives the UTC time directly; without one, or with a zone
    abbreviation, the time is read in ``default_tz`` and flagged as inferred.
    Text in no known layout gives a NULL ts and keeps ts_raw. For whole tables of
    records ``with_datetime`` does the same by plain projections, which compile.
    """
    zone = resolve_zone(default_tz)

    def resolve(t, s):
        return F.struct(*[c.alias(n) for n, c in _resolved(t["local"], t["offset"], s, zone).items()])

    def parse(s):
        return let(_date_parts(s), lambda p: let(
            F.struct(_local_time(p).alias("local"), let(_zone_digits(p[7]), _offset_of).alias("offset")),
            lambda t: resolve(t, s),
        ))

    return let(trim_space(text), parse)


def with_datetime(rows: DataFrame, text: str, default_tz: str = "UTC") -> DataFrame:
    """Rows with ``time_ts``, ``time_offset`` and ``time_inferred`` parsed from the column ``text``.

    Every value that is used twice is a column of a projection of its own, so nothing is
    worked out twice and all of it is compiled.
    """
    kept = rows.columns
    trimmed = rows.select("*", trim_space(F.col(text)).alias("_date"))
    taken = trimmed.select("*", memo(("date parts",), lambda: _date_parts(F.col("_date"))).alias("_parts"))
    part = [F.get(F.col("_parts"), F.lit(i)) for i in range(8)]
    split = taken.select(
        *kept, "_date", memo(("local time",), lambda: _local_time(part)).alias("_local"), _zone_digits(part[7]).alias("_digits"))
    local = split.select(*kept, "_date", "_local", _offset_of(F.col("_digits")).alias("_offset"))
    done = _resolved(F.col("_local"), F.col("_offset"), F.col("_date"), resolve_zone(default_tz))
    return local.select(
        *kept, done["ts"].alias("time_ts"), done["tz_offset"].alias("time_offset"), done["tz_inferred"].alias("time_inferred"))


def first_date(text: Column) -> Column:
    """The first part of a text that looks like a date-time, else NULL.

    All layouts hold a time of day, which most text does not: that is tested first.
    """
    timed = F.contains(text, F.lit(":")) & text.rlike(r"\d:\d\d:\d\d")
    return F.when(timed, F.nullif(F.regexp_extract(text, ANY_DATE, 0), F.lit("")))


def millis_to_ts(millis: Column) -> Column:
    """Epoch milliseconds as a UTC time; NULL outside the representable range."""
    inside = millis.between(-62_135_596_800_000, 253_402_300_799_999)
    return F.when(inside, F.timestamp_add("MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))


# ---- buckets -----------------------------------------------------------------

BUCKET_UNITS = ("month", "day", "hour", "minute")


def bucket_unit(unit: str | None) -> str:
    return unit if unit in BUCKET_UNITS else "day"


def bucket_keys(ts: Column, unit: str) -> dict[str, Column]:
    """Integer grouping keys of a bucket: cheap to hash, labelled after the grouping."""
    unit = bucket_unit(unit)
    day = ts.cast("date")
    keys = {"bucket_day": F.trunc(day, "MM") if unit == "month" else day}
    if unit in ("hour", "minute"):
        keys["bucket_hour"] = F.hour(ts)
    if unit == "minute":
        keys["bucket_minute"] = F.minute(ts)
    return keys


def bucket_label(keys: dict[str, Column], unit: str) -> Column:
    """ISO prefix text of a bucket from its keys."""
    unit = bucket_unit(unit)
    day = keys["bucket_day"].cast("string")
    if unit == "month":
        return F.substring(day, 1, 7)
    label = day
    if "bucket_hour" in keys:
        label = F.concat(label, F.lit("T"), F.lpad(keys["bucket_hour"].cast("string"), 2, "0"))
    if "bucket_minute" in keys:
        label = F.concat(label, F.lit(":"), F.lpad(keys["bucket_minute"].cast("string"), 2, "0"))
    return label


def time_bucket(ts: Column, unit: str = "day") -> Column:
    """ISO prefix text of a time's bucket; an unknown unit means day."""
    return bucket_label(bucket_keys(ts, unit), unit)
