"""Ingest: scraped rows to showtimes, in set-based stages.

Rows are matched against the stored movies; what is left is clustered among
itself by title, people and year, and gets new ids. This replaces a row-by-row
loop whose outcome depended on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D
from lumenreel.functions.titles import canonical_title
from lumenreel.operators import relational as R
from lumenreel.operators import resolution as E
from lumenreel.operators import snapshots as S


def parsed(scraped: DataFrame, now: str) -> DataFrame:
    """Scraped rows with canonical title, start (UTC), format, and the program flag; ``position`` orders them."""
    titles = scraped.select("movie_title").distinct().withColumn("title", canonical_title("movie_title"))
    rows = scraped.join(titles, "movie_title").withColumns({"start": D.parse_start(F.col("start_raw"), now), "format": N.normal_format(F.col("raw_format")), "program": T.program_content(F.col("movie_title"), F.col("overview"))})
    return rows


def listing(rows: DataFrame) -> DataFrame:
    """Parsed rows with a start, the first of each title, time and format."""
    return R.keep_first(rows.filter(F.col("start").isNotNull()), ["title", "start", "format"], ["position"])


def new_movies(rows: DataFrame, known: int) -> DataFrame:
    """Movies for rows without one, by title key, people and year give or take one; ids follow ``known``."""
    keyed = rows.withColumns({"people": E.people_signature(F.coalesce("director", F.lit("")))})
    by = Window.partitionBy("title_key", "people").orderBy("year", "position")
    far = F.coalesce(F.col("year") - F.lag("year").over(by) > 1, F.lit(False))
    grouped = keyed.withColumn("far", far.cast("int")).withColumn("cluster", F.sum("far").over(by))
    first = grouped.groupBy("title_key", "people", "cluster").agg(F.min_by(F.struct("title", "director", "year"), "position").alias("m"), F.min("position").alias("at"), F.collect_set("position").alias("positions"))
    return R.numbered(first, ["at"], "movie_id", known).select("movie_id", "m.*", "positions")


def tombstoned(stored: DataFrame, rows: DataFrame, theater: int, slug: str, now: str) -> DataFrame:
    """The stored showtimes after one theater's listing: upserted by fingerprint, what the listing lacks canceled."""
    keyed = rows.withColumn("fingerprint", E.fingerprint(F.lit(slug), F.col("title"), F.col("start"), F.col("format"))).withColumn("theater_id", F.lit(theater).cast("long"))
    incoming = R.keep_first(keyed, ["fingerprint"], ["position"]).select("fingerprint", "movie_id", "theater_id", "start", "format")
    merged = S.upsert(stored, incoming, ["fingerprint"], reset={"status": F.lit("SCHEDULED")})
    return S.tombstone_missing(merged, incoming, "fingerprint", F.col("theater_id") == theater, "start", "status", now)
