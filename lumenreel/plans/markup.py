"""Selectors over the whole pages, and a listing by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.plans.base import query, table
from lumenreel.sources import structure as S

_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\s ]+', ' ', 'g'))".replace('\\"', '"')


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "html")


@query("page_links", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">([^<]*)</a>', 0)) AS a FROM pages)
SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, """ + _PLAIN.format("regexp_extract(a, '>([^<]*)<', 1)") + " AS text FROM l")
def page_links(spark, sf_dir):
    """Links of each page's menu: nav ul > li > a."""
    found = S.tokens(_pages(spark, sf_dir))
    links = S.select(S.elements(found), "nav ul > li > a[href]")
    return S.with_text(links, S.texts(found)).select("page_id", S.attribute("href").alias("href"), "text")


@query("page_paragraphs", r"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
p AS (SELECT page_id, regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1) AS h, unnest(list_transform(string_split(a, '<p>')[2:], lambda x: string_split(x, '</p>')[1])) AS p, generate_subscripts(string_split(a, '<p>')[2:], 1) AS n FROM a)
SELECT page_id, n, """ + _PLAIN.format("regexp_replace(h, '<[^>]*>', '', 'g')") + " AS title, " + _PLAIN.format("regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g')") + " AS paragraph FROM p")
def page_paragraphs(spark, sf_dir):
    """Each article as a card with a title, its paragraphs as rows; paragraphs are not always closed."""
    site = S.Site(card="article", rows="p", fields={"title": ("h1", "text")}, row_fields={"paragraph": "text"})
    rows = S.listing(_pages(spark, sf_dir), site)
    place = F.row_number().over(S.Window.partitionBy("page_id", "card").orderBy("start")).cast("long")
    return rows.select("page_id", place.alias("n"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("paragraph", F.lit("")).alias("paragraph"))


@query("page_tags", r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY 1""")
def page_tags(spark, sf_dir):
    """Elements by tag over all pages."""
    return S.elements(S.tokens(_pages(spark, sf_dir))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))
