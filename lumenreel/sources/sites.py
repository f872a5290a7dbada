"""Listings of sites by rules that are data, found by the site's slug.

A site needs no code of its own: its rules say what a card is, what is read in it, and
which rows are showtimes. Pages of several sites are read together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.operators.relational import union_all
from lumenreel.sources.listings import SCRAPED, scraped
from lumenreel.sources.structure import Site, listing


@dataclass(frozen=True)
class Listing:
    """Rules, what must stand in a film's address, and by what a meta line is parted (None: read as a whole)."""

    site: Site
    film_path: str = ""
    meta_by: str | None = "/"


# Selectors of the sites' markup.
SITES = {
    "metrograph": Listing(
        Site(
            card=".homepage-in-theater-movie",
            fields={"title": ("h3.movie_title a", "text"), "address": ("h3.movie_title a", "href"), "meta": ("h5", "text", 1), "poster": ("img.main-image", "src")},
            rows=".showtimes > div.film_day a",
            row_fields={"time": "text", "ticket": "href"},
            running={"date": (".showtimes > h6, .showtimes > h5.sr-only", "text")},
        )
    ),
    "quad": Listing(
        Site(
            card=".now-single-day",
            fields={"date": (".trailing-rule-wrap h1", "text")},
            rows=".now-listings .single-listing ul.showtimes-list li a",
            row_fields={"time": "text", "ticket": "href"},
            running={"title": (".single-listing h4 a", "text"), "address": (".single-listing h4 a", "href")},
        ),
        film_path="/film/",
    ),
    "roxy": Listing(
        Site(
            card=".detailed-screening__card",
            fields={
                "title": (".detailed-screening__title", "text"),
                "meta": (".detailed-screening__info", "text"),
                "ticket": ('.detailed-screening__cta[href*="/purchase/"]', "href"),
                "address": (".detailed-screening__cta.cta--text-link", "href"),
                "overview": (".detailed-screening__copy", "text"),
                "poster": (".detailed-screening__image", "src"),
            },
            rows=".detailed-screening__time",
            row_fields={"time": "text"},
            card_fields={"moment": "data-datetime"},
        ),
        meta_by=None,
    ),
}

def _address(path: Column, page: Column) -> Column:
    """An address as a page at ``page`` means it."""
    site, link = F.regexp_extract(page, r"^[a-zA-Z]+://[^/?#]+", 0), F.trim(path)
    folder = F.when(F.rlike(page, F.lit(r"^[a-zA-Z]+://[^/]+/")), F.regexp_extract(page, r"^[^?#]*/", 0)).otherwise(F.concat(site, F.lit("/")))
    absolute = F.rlike(link, F.lit("^(?i)[a-z][a-z0-9+.-]*:"))
    scheme = F.regexp_extract(page, "^[a-zA-Z]+:", 0)
    return F.when(absolute, link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(site, link)).when(link != "", F.concat(folder, link))


def scraped_listing(pages: DataFrame, rules: Listing) -> DataFrame:
    """``pages`` (page_id, url, html) of one site as scraped showtimes."""
    site = rules.site
    found = listing(pages, site).join(pages.select("page_id", "url"), "page_id")
    have = lambda c: F.col(c) if c in found.columns else F.lit(None).cast("string")
    found = found.filter(F.contains(F.coalesce(have("address"), F.lit("")), F.lit(rules.film_path))) if rules.film_path else found
    meta = N.meta(have("meta"), rules.meta_by) if rules.meta_by else None
    start = F.concat_ws(" ", have("date"), F.regexp_replace(have("time"), r"\*", ""))
    return scraped(
        found, movie_title=T.clean(have("title")), start_raw=F.coalesce(have("moment"), start), ticket_url=_address(have("ticket"), F.col("url")), source_url=F.coalesce(_address(have("address"), F.col("url")), "url"),
        raw_format=meta.format if rules.meta_by else N.find_format(have("meta")), year=meta.year if rules.meta_by else N.year(have("meta")), runtime=meta.runtime if rules.meta_by else N.runtime(have("meta")),
        overview=have("overview"), poster_url=_address(have("poster"), F.col("url")), page_id=F.col("page_id"),
    )


def scraped_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, slug, url, html) of all sites that have rules, as scraped showtimes with page_id and slug; other slugs give nothing."""
    parts = [scraped_listing(pages.filter(F.col("slug") == slug), rules).withColumn("slug", F.lit(slug)) for slug, rules in SITES.items()]
    return union_all(*parts).select("page_id", "slug", *SCRAPED)
