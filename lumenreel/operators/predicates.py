"""Filters as column expressions. ``now`` is always a parameter; times are UTC without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE, SCHEDULED, ACTIVE = "America/New_York", "SCHEDULED", "ACTIVE"


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def upcoming(start: Column, status: Column, now: str, scheduled: str = SCHEDULED) -> Column:
    """Scheduled and strictly later than now."""
    return (start > moment(now)) & (status == scheduled)


def to_utc(local: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def to_local(utc: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def in_day(start: Column, day: str, now: str, zone: str = ZONE) -> Column:
    """Within the zone's day, both ends included; today counts from now on."""
    first, last = to_utc(moment(day), zone), to_utc(moment(f"{day} 23:59:59.999"), zone)
    today = F.date_format(to_local(moment(now), zone), "yyyy-MM-dd") == day
    return (start >= F.when(today, F.greatest(first, moment(now))).otherwise(first)) & (start <= last)


def expired(start: Column, end: Column, now: str) -> Column:
    """Ended before now; without an end, started before now."""
    return (end < moment(now)) | (end.isNull() & (start < moment(now)))


def needs_end(end: Column, runtime: Column, movie_runtime: Column) -> Column:
    return end.isNull() & ((runtime > 0) | (movie_runtime > 0))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def contains_text(text: Column, query: Column) -> Column:
    return F.contains(F.lower(text), F.lower(query))


def starts_with_text(text: Column, query: Column) -> Column:
    return F.startswith(F.lower(text), F.lower(query))


def mail_enabled(email: Column, enabled: Column) -> Column:
    """A user with an address; a missing settings row counts as enabled."""
    return F.coalesce(email != "", F.lit(False)) & F.coalesce(enabled, F.lit(True))


def visible_post(post_status: Column, start: Column, status: Column, now: str, scheduled: str = SCHEDULED) -> Column:
    return (post_status == ACTIVE) & upcoming(start, status, now, scheduled)


def blocked_response(status: Column, headers: Column, body: Column) -> Column:
    """A landed response that is a challenge page and no listing.

    ``headers`` is a map with lower-case names.
    """
    # Signs of a challenge page, lower case.
    signs = ["just a moment...", "enable javascript and cookies to continue", "attention required!", "cf-browser-verification"]
    text = F.lower(F.coalesce(body, F.lit("")))
    some = F.lit(False)
    for sign in signs:
        some = some | F.contains(text, F.lit(sign))
    return (F.coalesce(status, F.lit(0)) == 403) | (F.coalesce(F.lower(headers["cf-mitigated"]), F.lit("")) == "challenge") | some


def present(value: Column) -> Column:
    """Empty strings and zeros count as missing."""
    text = value.cast("string")
    return F.when((text != "") & (text != "0") & (text != "0.0"), value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*map(present, values))
