"""Small texts of listings and inputs: credits, overviews, labels of days and times, market fields. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse, html_text
from lumenreel.functions.times import _let
from lumenreel.operators.predicates import ZONE, to_local, to_utc

# What ends a director credit, formats in overviews, types of posts.
CREDIT_STOPS = (
    r"\b(18|19|20)\d{2}\b",
    r"(?i)\b\d+\s*min\b",
    r"(?i)\b(4k dcp|dcp|35mm|70mm|imax|digital)\b",
    r"(?i)\bthe first\b",
    r"(?i)\bwinner\b",
    r"(?i)\bpresented\b",
    r"(?i)\bproduced by\b",
)
OVERVIEW_FORMAT = r"(?i)\b(4K DCP|DCP|35MM|70MM|IMAX|DIGITAL)\b"
POST_TYPES = ("BUY", "SELL")


def _at(text: Column, pattern: str) -> Column:
    """Place of the first match from 1 on, 0 without one."""
    return F.regexp_instr(text, F.lit(pattern))


def director_text(c: Column, fallback: str = "Unknown") -> Column:
    """A credit up to the first thing that is no name."""
    plain = F.trim(F.regexp_replace(collapse(c), r"(?i)^directed by\s*", ""))

    def cut(x: Column) -> Column:
        places = [F.when(_at(x, p) > 0, _at(x, p) - 1).otherwise(F.length(x)) for p in CREDIT_STOPS]
        return F.trim(F.substring(x, F.lit(1), F.least(*places)))

    return F.coalesce(F.nullif(_let(plain, cut), F.lit("")), F.lit(fallback))


def overview_meta(c: Column) -> Column:
    """Struct of an overview: meta_line (year, runtime, format), body behind it where text stands before it too, and format.

    The line's parts are found anywhere; the body begins behind the last kind of part that is there.
    """
    year, minutes = r"\b(18|19|20)\d{2}\b", r"(?i)(\d+)\s*min\.?"

    def take(text: Column) -> Column:
        # What stands before and behind the first match of each part; a part that is not there splits nothing off.
        parts = {p: F.split(text, p, 2) for p in (year, minutes, OVERVIEW_FORMAT)}
        behind = lambda p: F.when(F.size(parts[p]) > 1, F.element_at(parts[p], 2))
        found = [F.regexp_extract(text, year, 0), F.nullif(F.regexp_extract(text, minutes, 1), F.lit("")), F.regexp_extract(text, OVERVIEW_FORMAT, 1)]
        line = F.array_join(F.filter(F.array(found[0], F.concat(found[1], F.lit("min")), found[2]), lambda x: x != ""), " / ")
        rest = F.trim(F.coalesce(behind(OVERVIEW_FORMAT), behind(minutes), F.lit("")))
        framed = (F.size(parts[year]) > 1) & (F.trim(F.element_at(parts[year], 1)) != "") & (rest != "")
        return F.struct(line.alias("meta_line"), F.when(framed, rest).otherwise(text).alias("body"), found[2].alias("format"))

    return _let(collapse(c), take)


def date_label(c: Column) -> Column:
    """A day's text without markup, commas followed by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(html_text(c)), r"\s*,\s*", ", "), r"\s+", " "))


#: A time of day: hour, minutes behind a colon or a point, and the half of the day, with or without points and spaces.
TIME = r"(?i)^(\d{1,2})(?:[:.](\d{2}))?\s*(?:([ap])\.?\s*m\.?)?$"


def time_label(c: Column) -> Column:
    """A time's text as ``h:mm AM``, parts that it lacks left out; other texts as they are, without markup."""
    text = collapse(html_text(c))
    part = lambda i: F.nullif(F.regexp_extract(text, TIME, i), F.lit(""))
    label = F.concat_ws(" ", F.concat_ws(":", part(1), part(2)), F.concat(F.upper(part(3)), F.lit("M")))
    return F.when(F.rlike(text, F.lit(TIME)), label).otherwise(text)


def time_of_day(c: Column) -> Column:
    """Minutes after midnight of a label: h AM, h:mm PM, or HH:mm; null where it is none of these."""
    text = collapse(html_text(c))
    part = lambda i: F.nullif(F.regexp_extract(text, TIME, i), F.lit(""))
    hour, minute, half = part(1).try_cast("int"), part(2).try_cast("int"), F.lower(part(3))
    twelve = F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    hours = F.when(half.isNotNull(), twelve).when(minute.isNotNull() & (hour < 24), hour)
    return F.when(F.coalesce(minute, F.lit(0)) < 60, hours * 60 + F.coalesce(minute, F.lit(0)))


def combine(day: Column, time: Column, zone: str = ZONE) -> Column:
    """UTC of a local day (a date) at a time label of the zone."""
    minutes = time_of_day(time)
    return to_utc(day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes), zone)


def raw_label(utc: Column, zone: str = ZONE) -> Column:
    return F.date_format(to_local(utc, zone), "EEEE, MMMM d, yyyy h:mm a")


def epoch_label(seconds: Column, zone: str = ZONE) -> Column:
    """A local day's long label of seconds since 1970."""
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.date_format(to_local(utc, zone), "MMMM d, yyyy")


def iso_day_or(c: Column, fallback: str) -> Column:
    """A valid ISO day, else the fallback."""
    text = F.trim(c)
    return F.coalesce(F.date_format(F.try_to_date(F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text), "yyyy-MM-dd"), "yyyy-MM-dd"), F.lit(fallback))


def watched_at(c: Column) -> Column:
    """Struct (at, valid): a day alone is noon UTC, a full ISO time is itself; nothing is valid and null, other texts are not valid."""
    text = F.trim(F.coalesce(c, F.lit("")))
    day = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    at = F.when(day, F.try_to_timestamp(F.concat(text, F.lit(" 12:00:00"))).cast("timestamp_ntz")).otherwise(F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast("timestamp_ntz"))
    return F.struct(F.when(text != "", at).alias("at"), ((text == "") | at.isNotNull()).alias("valid"))


def active_day(c: Column, now: str, months: int = 12) -> Column:
    """A day from the zone's today to so many months later, both included."""
    today = to_local(F.lit(now).cast("timestamp_ntz")).cast("date")
    day = F.try_to_date(c, "yyyy-MM-dd")
    return F.coalesce(day.between(today, F.add_months(today, months)), F.lit(False))


def release_year(utc: Column) -> Column:
    return F.year(utc)


def post_type(c: Column) -> Column:
    kind = F.upper(collapse(c))
    return F.when(kind.isin(*POST_TYPES), kind)


def display_name(c: Column, unnamed: str) -> Column:
    """A user's name; ``unnamed`` stands for those without one."""
    return F.coalesce(F.nullif(collapse(c), F.lit("")), F.lit(unnamed))
