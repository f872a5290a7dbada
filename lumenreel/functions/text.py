"""Text functions as column expressions; only accent stripping needs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers see it: Unicode white space and the byte order mark.
SPACE = r"(?U)[\s\x{FEFF}]+"


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_s(c), SPACE, " "))


def decode_escapes(c: Column) -> Column:
    r"""Literal \uXXXX sequences as their characters."""
    parts = F.split(_s(c), r"\\u(?=[0-9a-fA-F]{4})")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE"), F.substring(x, 5, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def clean(c: Column) -> Column:
    return collapse(decode_escapes(c))


def strip_quotes(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(clean(c), "^[\"']+", ""), "[\"']+$", ""))


# Entities and what they stand for, in the order in which they are replaced.
ENTITIES = [
    ("&amp;", "&"), ("&#038;", "&"), ("&#8217;", "’"), ("&#8216;", "‘"), ("&quot;", '"'), ("&#8220;", '"'), ("&#8221;", '"'),
    ("&nbsp;", " "), ("&#160;", " "), ("&hellip;", "…"), ("&#8230;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", '"'), ("&ldquo;", '"'),
]


def decode_entities(c: Column) -> Column:
    for entity, text in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def comparable(c: Column) -> Column:
    return F.lower(clean(c))


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks."""
    return s.map(lambda t: t if t is None or t.isascii() else "".join(ch for ch in unicodedata.normalize("NFD", t) if not "̀" <= ch <= "ͯ"))


def loose(c: Column) -> Column:
    """Letters and digits of the plain alphabet, one space between words; & reads and."""
    plain = F.replace(F.replace(strip_marks(comparable(c)), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    """Key of an (already canonical) name: lower case, no marks or apostrophes, letters and digits of any script."""
    return F.trim(F.regexp_replace(F.replace(strip_marks(F.lower(_s(c))), F.lit("'"), F.lit("")), r"[^\p{L}\p{N}]+", " "))


def director_key(c: Column) -> Column:
    """As a name key, but commas stay and a leading "directed by" goes."""
    plain = F.replace(strip_marks(F.lower(F.regexp_replace(_s(c), r"(?i)^directed by\s*", ""))), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N},\s]+", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_marks(F.lower(F.trim(_s(c)))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_bullets(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean(c), r"^[·•●▪◦‣.\s]+", ""))


def unique_texts(texts: Column) -> Column:
    """Cleaned texts of an array, first of each comparable form, no empty ones."""
    cleaned = F.filter(F.transform(texts, clean), lambda x: x != "")
    return F.aggregate(cleaned, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


# Words that make a title a program rather than a film.
PROGRAM_WORDS = ["presented by", "retrospective", "comprehensive retrospective", "archive dive", "program", "series", "q&a", "conversation", "double feature", "shorts", "festival", "tribute"]
# Patterns of program titles.
PROGRAM_TITLES = [r"\btribute\b", r"\bprogram\b", r"\bpgm\b", r"\bshorts\b", r"\bdouble feature\b", r"\bepisodes\b", r"\bpanel\b", r"\bsecret screening\b", r"\bmembers only\b", r"\baward-winning shorts\b", r"\bpresents\b"]
# Patterns of overviews of programs, and a phrase in them.
PROGRAM_OVERVIEWS = [
    r"\bprogram of shorts\b",
    r"\bshort film program\b",
    r"\bpresents a program\b",
    r"\bas part of\b",
    r"\bpart of (?:the )?.+?\b(?:festival|retrospective|series)\b",
    r"\bthis (?:festival|retrospective|series)\b",
]
PROGRAM_PHRASE = "special thanks to"


def program_title(c: Column) -> Column:
    text = F.lower(collapse(c))
    return (text != "") & F.rlike(text, F.lit("|".join(PROGRAM_WORDS)))


def program_content(title: Column, overview: Column) -> Column:
    text = comparable(overview)
    return F.rlike(comparable(title), F.lit("|".join(PROGRAM_TITLES))) | F.rlike(text, F.lit("|".join(PROGRAM_OVERVIEWS))) | F.contains(text, F.lit(PROGRAM_PHRASE))


def words(c: Column) -> Column:
    """Number of words."""
    return F.when(collapse(c) == "", 0).otherwise(F.size(F.split(collapse(c), " "))).cast("int")


def split_list(c: Column, by: str = ",") -> Column:
    return F.filter(F.transform(F.split(_s(c), by), lambda x: collapse(x)), lambda x: x != "")


def imdb_id(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_s(c), r"(?i)tt\d{7,10}", 0)), F.lit(""))


def canonical_url(c: Column, drop_query: bool = False) -> Column:
    """Without fragment and trailing slashes."""
    url = F.regexp_replace(F.trim(_s(c)), r"\?.*$|#.*$" if drop_query else "#.*$", "")
    return F.nullif(F.regexp_replace(url, "/+$", ""), F.lit(""))


def absolute_url(path: Column, base: str) -> Column:
    site = "/".join(base.split("/")[:3])
    folder = base.rsplit("/", 1)[0] if base.count("/") > 2 else site
    link = F.trim(_s(path))
    return F.when(link == "", None).when(F.rlike(link, F.lit("^(?i)[a-z][a-z0-9+.-]*:")), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit(base.split("//")[0]), link)).when(F.startswith(link, F.lit("/")), F.concat(F.lit(site), link)).otherwise(F.concat(F.lit(folder + "/"), link))


def html_text(c: Column) -> Column:
    """Text of markup: breaks and block ends as spaces, no scripts, styles or comments."""
    bare = F.regexp_replace(_s(c), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return collapse(decode_entities(F.regexp_replace(bare, "(?s)<[^>]*>", " ")))


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def mask_mail(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(_s(c))), "^(.).*?(@.*)$", "$1***$2")


# Parts of addresses of pictures that are logos or placeholders.
BAD_POSTERS = ["ticketing.uswest.veezi.com/media/poster", "ticketing.us.veezi.com/media/poster", "cropped-logo_metrograph", "/logo_metrograph", "metrographred.png", "bam_logo.gif", "/static/img/logo/"]


def bad_poster(c: Column) -> Column:
    url = F.lower(collapse(c))
    some = url == ""
    for part in BAD_POSTERS:
        some = some | F.contains(url, F.lit(part))
    return some


def mostly_han(c: Column) -> Column:
    letters, han = F.regexp_replace(_s(c), r"[^\p{L}]", ""), F.regexp_replace(_s(c), r"[^\p{IsHan}]", "")
    return (F.length(letters) > 0) & (F.length(han) * 2 >= F.length(letters))


def display_title(shown: Column, title: Column) -> Column:
    """The shown title unless it only repeats the title."""
    return F.when(F.lower(collapse(shown)) == F.lower(collapse(title)), "").otherwise(collapse(shown))


def is_free(ticket: Column) -> Column:
    return F.upper(F.trim(_s(ticket))) == "FREE"
