"""Years, runtimes, formats, ratings, prices and page numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse

# Print formats and the patterns that show them, in the order in which they are tried.
FORMAT_PATTERNS = [(r"4K\s*DCP", "4K DCP"), (r"\bDCP\b", "DCP"), (r"35\s*MM", "35mm"), (r"16\s*MM", "16mm"), (r"70\s*MM", "70mm"), (r"\bIMAX\b", "IMAX"), (r"\bDIGITAL\b", "Digital"), (r"\bBLU[\s-]?RAY\b", "Blu-ray"), (r"\bSTANDARD\b", "Standard")]
# Parts of a raw format name and the stored format, in the order in which they are tried.
FORMAT_NAMES = [("70mm", "70mm"), ("35mm", "35mm"), ("16mm", "16mm"), ("super-8", "Super 8"), ("super 8", "Super 8"), ("imax", "IMAX"), ("3d", "3D"), ("dolby", "Dolby"), ("digital", "Digital"), ("4k dcp", "4K DCP"), ("dcp", "DCP")]


def year(c: Column) -> Column:
    return F.regexp_extract(collapse(c), r"\b((?:18|19|20)\d{2})\b", 1).try_cast("int")


def runtime(c: Column) -> Column:
    """Minutes, rounded half up."""
    text = collapse(c)
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)(\d+(?:\.\d+)?)\s*minutes?\b", r"(?i)(\d+(?:\.\d+)?)\s*mins?\b", r"(?i)^\s*(\d+(?:\.\d+)?)\s*m\s*$")]
    return F.floor(F.coalesce(*found).try_cast("double") + 0.5).cast("int")


def find_format(c: Column) -> Column:
    text = collapse(c)
    out = F.lit(None).cast("string")
    for pattern, name in reversed(FORMAT_PATTERNS):
        out = F.when(F.rlike(text, F.lit(f"(?i){pattern}")), name).otherwise(out)
    return out


def normal_format(c: Column) -> Column:
    text, out = F.lower(collapse(c)), F.lit("Standard")
    for part, name in reversed(FORMAT_NAMES):
        out = F.when(F.contains(text, F.lit(part)), name).otherwise(out)
    return out


def meta(c: Column, by: str = "/") -> Column:
    """struct<year, runtime, format, other>: the first part that gives each; other is the last that gives none."""
    parts = F.filter(F.transform(F.split(collapse(c), by), collapse), lambda x: x != "")
    plain = F.filter(parts, lambda x: year(x).isNull() & runtime(x).isNull() & find_format(x).isNull())
    safe = lambda a, n: F.try_element_at(a, F.lit(n))
    get = lambda f: F.try_element_at(F.filter(F.transform(parts, f), lambda x: x.isNotNull()), F.lit(1))
    third = safe(parts, 3)
    kind = F.coalesce(get(find_format), F.when(F.length(third) < 24, third)) if by == "/" else get(find_format)
    return F.struct(get(year).alias("year"), get(runtime).alias("runtime"), kind.alias("format"), safe(plain, -1).alias("other"))


def rating(c: Column) -> Column:
    """0 to 5 in halves, else null."""
    value = F.trim(c).try_cast("double")
    return F.when(value.between(0, 5) & (value * 2 == F.floor(value * 2)), value)


def price_label(cents: Column) -> Column:
    return F.when(cents.isNotNull(), F.concat(F.lit("$"), F.format_number(cents / 100, 2)))


def clamp(value: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def other_side(kind: Column) -> Column:
    return F.when(kind == "BUY", "SELL").when(kind == "SELL", "BUY")
