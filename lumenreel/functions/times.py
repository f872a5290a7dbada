"""Times: parsing of listing texts, inference of missing years, local dates. Times are UTC without zone."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse
from lumenreel.operators.predicates import ZONE, to_local, to_utc

_WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
_DATES, _CLOCKS = ("MMMM d yyyy", "MMM d yyyy", "yyyy-MM-dd", "M/d/yyyy", "M/d/yy"), (" h:mma", " h:mm a", " H:mm")


def _local_now(now: str) -> datetime:
    return datetime.fromisoformat(now).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(ZONE))


def _try(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns])


def parse_start(raw: Column, now: str) -> Column:
    """Start of a showtime from listing text, or null.

    Local wall-clock time, with or without weekday, comma and year. Without am or
    pm as a word of its own, hours 1 to 10 are afternoon; a date alone means noon;
    without a year the current one counts, or the next if that is over two months
    ago. Times with an offset are taken as they are.
    """
    local, hours = _local_now(now), lambda n: F.expr(f"INTERVAL '{n}' HOUR")
    this, old = str(local.year), F.lit(local.replace(tzinfo=None)).cast("timestamp_ntz") - F.expr("INTERVAL '2' MONTH")

    def date_first(text: Column) -> Column:
        """Date, year (the current one where none is given) and clock, in this order."""
        plain = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), r"(?<=\d),?\s+", " ")
        dated = F.regexp_replace(F.regexp_replace(plain, r"^([A-Za-z]+\.?\s+\d{1,2})(?=\s|$)", f"$1 {this}"), r"^(\d{1,2}/\d{1,2})(?=\s|$)", f"$1/{this}")
        return F.regexp_replace(F.when(_has_year(text), plain).otherwise(dated), r"(?i)^([A-Za-z]+ \d{1,2}) (\d{1,2}:\d{2}\s*(?:am|pm)?) (\d{4})$", "$1 $3 $2")

    def written(text: Column) -> Column:
        half, clock = F.rlike(text, F.lit(r"(?i)\b(am|pm)\b")), F.rlike(text, F.lit(r"\d{1,2}:\d{2}"))
        parsed = _let(date_first(text), lambda t: _try(t, [*[d + c for d in _DATES for c in _CLOCKS], *_DATES]))
        noon = _let(parsed, lambda t: F.when(~clock & (F.hour(t) == 0) & (F.minute(t) == 0), t + hours(12)).otherwise(t))
        late = _let(noon, lambda t: F.when(~half & clock & F.hour(t).between(1, 10), t + hours(12)).otherwise(t))
        return _let(late, lambda t: F.when(~_has_year(text) & (t < old), t + F.expr("INTERVAL '12' MONTH")).otherwise(t))

    def either(text: Column) -> Column:
        iso, zoned = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}T")), F.rlike(text, F.lit(r"(?:Z|[+-]\d{2}:?\d{2})$"))
        stamp = F.try_to_timestamp(text).cast("timestamp_ntz")
        instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp)
        return F.when(iso & zoned, instant).otherwise(to_utc(F.when(iso, stamp).otherwise(written(text))))

    return _let(collapse(raw), either)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _has_year(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\b(18|19|20)\d{2}\b"))


def nearest_year(month: Column, day: Column, now: str) -> Column:
    """Of last, this and next year the one whose date is nearest to now; the earlier on ties."""
    today = _local_now(now)
    years = [today.year - 1, today.year, today.year + 1]
    date = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", F.lit(y), month, day))
    options = F.array(*[F.struct(F.abs(F.datediff(date(y), F.lit(today.date()))).alias("far"), F.lit(y).alias("year")) for y in years])
    return F.array_min(F.filter(options, lambda x: x.far.isNotNull())).year


def local_day(utc: Column) -> Column:
    return F.date_format(to_local(utc), "yyyy-MM-dd")


def local_clock(utc: Column) -> Column:
    return F.date_format(to_local(utc), "HH:mm")


def mail_label(utc: Column) -> Column:
    return F.date_format(to_local(utc), "EEE, MMM d 'at' h:mm a")


def end_of(start: Column, minutes: Column) -> Column:
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def noon_of(c: Column) -> Column:
    """A day written with dashes, slashes or dots, as noon UTC."""
    parts = [F.regexp_extract(F.trim(c), r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", i).try_cast("int") for i in (1, 2, 3)]
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d 12:00:00", *parts)).cast("timestamp_ntz")


def iso_utc(utc: Column) -> Column:
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def ics_time(value: Column, zone: Column) -> Column:
    """An iCalendar time: UTC with Z, a date alone, or wall-clock time of a zone."""
    parsed = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(value, "Z$", ""), F.lit(p)).cast("timestamp_ntz") for p in ("yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm", "yyyyMMdd")])
    return F.when(F.endswith(value, F.lit("Z")), parsed).otherwise(F.convert_timezone(F.coalesce(zone, F.lit(ZONE)), F.lit("UTC"), parsed))
