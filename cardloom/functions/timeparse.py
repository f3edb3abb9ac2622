"""Written timestamps to instants, in JVM expressions.

A value is first rewritten to one canonical string by the first format whose pattern it matches; that string is split once
into its parts. Nothing is guessed: a value of no known form, or of an impossible date, is neither an instant nor a date.
"""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets in minutes of the zone abbreviations that are read.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:Z|z|UTC?|GMT)?[+\-−]\d{2}:?\d{2}|[+\-−]\d{2}|[A-Za-z]{1,5}|[A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+"
#: (pattern, canonical form "year|month|day|hour|minute|second|fraction|am or pm|zone"); the first that matches counts.
_FORMATS = (
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}\s*({_ZONE})?\s*(?:\[({_ZONE})\])?$", r"$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[Tt]|\s+){_CLOCK}\s*({_ZONE})?$", r"$1|$2|$3|$4|$5|$6|$7||$8|"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})?({_ZONE})?$", r"$1|$2|$3|$4|$5|$6|||$7|"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{4}})\s+{_CLOCK}\s*({_ZONE})?$", r"$3|$2|$1|$4|$5|$6|$7||$8|"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s*(?:(上午|下午)\s*)?(\d{1,2}):(\d{2})(?::(\d{2}))?$", r"$1|$2|$3|$5|$6|$7||$4||"),
)
_DAY_FIRST = rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}),?\s+{_CLOCK}\s*(?:([AaPp])\.?[Mm]\.?)?\s*({_ZONE})?$"
_DATE_FORMATS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"$1|$2|$3"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", r"$1|$2|$3"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})$", r"$3|$2|$1"),
)
_DATE_DAY_FIRST = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$"


@lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    """IANA region names, from the time-zone database."""
    return tuple(sorted(z for z in zoneinfo.available_timezones() if "/" in z or z == "UTC"))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^[\s​﻿]+|[\s​﻿]+$", "")


def _first(value: Column, formats: list[tuple[Column | str, str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for guard, pattern, form in reversed(formats):
        hit = value.rlike(pattern) if isinstance(guard, str) else guard & value.rlike(pattern)
        out = F.when(hit, F.regexp_replace(value, pattern, form)).otherwise(out)
    return out


def _number(text: Column) -> Column:
    return F.when(F.length(text) > 0, text.try_cast("int"))


def _month_number(text: Column) -> Column:
    at = F.position(F.lower(F.substring(text, 1, 3)), F.lit(_MONTHS))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int")).when((at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3).cast("int") + 1)


def _offset_minutes(plain: Column, digits: Column) -> Column:
    """Minutes east of UTC of an offset or abbreviation; null for anything else."""
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0))
    signed = F.when(plain.rlike(r"^[A-Za-z]*[\-−]"), -minutes).otherwise(minutes)
    named = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.when((digits != "") & (minutes <= 18 * 60), signed).otherwise(F.try_element_at(named, F.upper(plain)))


def _wall_to_utc(wall: Column, zone: Column) -> Column:
    """The instant of a wall-clock time: the earlier one where it occurs twice, moved on by the skip where it was skipped."""
    return F.when(zone.isin(*known_zones()), F.to_utc_timestamp(wall, zone))


def canonical_zone(zone: Column) -> Column:
    """A garden's zone; UTC where it is null or blank."""
    stripped = _strip(zone)
    return F.when(stripped.isNull() | (stripped == ""), F.lit("UTC")).otherwise(stripped)


def month_first(locale: Column) -> Column:
    """Whether a locale writes the month before the day: English without a region, or of the United States."""
    return F.coalesce(F.lower(_strip(locale)).rlike(r"^en(?:[-_](?:us|ph))?$"), F.lit(False))


def canonical_form(raw: Column, month_first: Column) -> tuple[Column, Column]:
    """(canonical instant form, canonical date form); null where the value has no such form."""
    s = _strip(raw)
    instant = [("", p, f) for p, f in _FORMATS]
    instant += [(month_first, _DAY_FIRST, r"$3|$1|$2|$4|$5|$6|$7|$8|$9|"), (~month_first, _DAY_FIRST, r"$3|$2|$1|$4|$5|$6|$7|$8|$9|")]
    date = [("", p, f) for p, f in _DATE_FORMATS]
    date += [(month_first, _DATE_DAY_FIRST, r"$3|$1|$2"), (~month_first, _DATE_DAY_FIRST, r"$3|$2|$1")]
    return _first(s, instant), _first(s, date)


def parse(values: DataFrame) -> DataFrame:
    """`instant_` and `date_` for each (raw_, zone_, month_first_); other columns are kept.

    A bare number counts from 1970: seconds, or milli-, micro- or nanoseconds by its size. The steps are separate projections,
    each of a few columns, so that no pattern is evaluated twice.
    """
    form, day = canonical_form(F.col("raw_"), F.col("month_first_"))
    at = lambda k: F.get(F.col("part_"), F.lit(k))
    kept = values.columns
    df = values.select(*kept, F.split(form, r"\|").alias("part_"), F.split(day, r"\|").alias("day_"), _strip(F.col("raw_")).alias("s_"))
    df = df.withColumns(
        {
            "half_": F.upper(at(7)),
            "hour_": _number(at(3)),
            "month_": _month_number(at(1)),
            "second_": F.concat(F.when(at(5) != "", at(5)).otherwise("0"), F.lit("."), F.rpad(F.concat(at(6), F.lit("0")), 6, "0")).cast("decimal(16,6)"),
            "own_": F.when(at(8) != "", at(8)).when(at(9) != "", at(9)),
            "number_": F.when(F.col("s_").rlike(r"^-?\d{1,19}(?:\.\d{1,9})?$"), F.col("s_").try_cast("decimal(38,9)")),
        }
    )
    half, hour, number = F.col("half_"), F.col("hour_"), F.col("number_")
    hour24 = (
        F.when(half.isin("A", "P") & ~hour.between(1, 12), F.lit(None).cast("int"))
        .when(half.isin("A", "上午") & (hour == 12), 0)
        .when(half.isin("P", "下午") & (hour < 12), hour + 12)
        .otherwise(hour)
    )
    size = F.abs(number)
    micros = F.when(size < 10**11, number * 1_000_000).when(size < 10**14, number * 1_000).when(size < 10**17, number).otherwise(number / 1_000)
    plain = F.regexp_replace(F.col("own_"), r"[:\s]", "")
    df = df.withColumns(
        {
            "wall_": F.try_make_timestamp(_number(at(0)), F.col("month_"), _number(at(2)), hour24, _number(at(4)), F.when(F.col("second_") < 60, F.col("second_")), F.lit("UTC")),
            "plain_": plain,
            "digits_": F.regexp_extract(plain, r"^(?:[A-Za-z]+)?[+\-−](\d{2,4})$", 1),
            "counted_": F.timestamp_micros(F.floor(micros).cast("long")),
            "day_month_": _month_number(F.get(F.col("day_"), F.lit(1))),
        }
    )
    df = df.withColumns({"offset_": _offset_minutes(F.col("plain_"), F.col("digits_")), "region_": F.when(F.col("own_").isNull(), F.col("zone_")).otherwise(F.col("own_"))})
    wall, offset = F.col("wall_"), F.col("offset_")
    instant = (
        F.when(F.col("part_").isNull(), F.col("counted_"))
        .when(F.col("own_").isNotNull() & offset.isNotNull(), F.timestamp_micros(F.unix_micros(wall) - offset.cast("long") * 60_000_000))
        .otherwise(_wall_to_utc(wall, F.col("region_")))
    )
    day_at = lambda k: _number(F.get(F.col("day_"), F.lit(k)))
    date = F.when(F.col("day_month_").isNotNull(), F.format_string("%04d-%02d-%02d", day_at(0), F.col("day_month_"), day_at(2)).try_cast("date"))
    return df.select(*kept, instant.alias("instant_"), date.alias("date_"))


#: Microseconds from 1970 back to year 1: no instant is earlier.
_YEAR_ONE = -62_135_596_800_000_000
#: ISO forms: date, or date and clock time with or without seconds, fraction and offset; with or without the signs between.
_ISO = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?(Z|[+\-]\d{2}(?::?\d{2})?)?)?$"


def iso_instant(value: Column) -> Column:
    """The instant of an ISO date or time, UTC where it has no zone, blanks around it aside; null for any other value. What cards are
    ordered by: a bare date counts from its midnight."""
    s = _strip(value)
    parts = F.split(F.when(s.rlike(_ISO), F.regexp_replace(s, _ISO, "$1|$3|$4|$5|$6|$7|$8|$9")), r"\|")
    at = lambda k: F.coalesce(_number(F.get(parts, F.lit(k))), F.lit(0))
    micros = F.rpad(F.coalesce(F.get(parts, F.lit(6)), F.lit("")), 6, "0").try_cast("long")
    zone = F.regexp_replace(F.coalesce(F.get(parts, F.lit(7)), F.lit("")), "[:Z]", "")
    minutes = F.coalesce(_number(F.substring(zone, 2, 2)), F.lit(0)) * 60 + F.coalesce(_number(F.substring(zone, 4, 2)), F.lit(0))
    shift = F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes).cast("long") * 60_000_000
    wall = F.try_make_timestamp(F.when(at(0) > 0, at(0)), at(1), at(2), at(3), at(4), F.when(at(5) < 60, at(5)).cast("decimal(16,6)"), F.lit("UTC"))
    instant = F.unix_micros(wall) + micros - shift
    return F.when(parts.isNotNull() & (minutes < 24 * 60) & (instant >= _YEAR_ONE), F.timestamp_micros(instant))


def canonical_time(value: Column) -> Column:
    """The written form of a card's time: a bare date as it is, an instant in UTC with Z (and microseconds, if it has any), else empty."""
    s = _strip(F.coalesce(value, F.lit("")))
    at = iso_instant(s)
    form = F.when(F.unix_micros(at) % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(at.isNotNull(), s)).otherwise(form), F.lit(""))
