"""People: their films, their rows deduped and found again, and watches that end wants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse
from lumenreel.operators.relational import exists
from lumenreel.operators.snapshots import mark_watched, remove


def films_of_people(credits: DataFrame, showtimes: DataFrame) -> DataFrame:
    """person_id and the sorted ids of their films that have a showtime."""
    return exists(credits, showtimes, ["movie_id"]).groupBy("person_id").agg(F.array_sort(F.collect_set("movie_id")).alias("films"))


def dedupe_people(rows: DataFrame) -> DataFrame:
    """One row for each kind and external id (else name, without case): the first place, the last name, later values that are known.

    ``rows``: position, kind, tmdb_id, name, gender, billing. Rows without a name go.
    """
    named = rows.withColumn("name", collapse(F.col("name"))).filter("name <> ''")
    key = F.coalesce(F.concat(F.lit("#"), F.col("tmdb_id").cast("string")), F.concat(F.lit("="), F.lower("name")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c)
    found = named.groupBy("kind", key.alias("key__")).agg(F.min_by("tmdb_id", "position").alias("tmdb_id"), F.min("position").alias("place__"), last("name"), last("gender"), last("billing"))
    return found.select(F.col("place__").alias("position"), "kind", "tmdb_id", "name", "gender", "billing")


def find_people(asked: DataFrame, people: DataFrame, probe: str) -> DataFrame:
    """``asked`` (tmdb_id, name) with person_id: the stored person of the external id, else the first of that name without one; null if neither is stored."""
    by_id = people.filter("tmdb_id is not null").groupBy("tmdb_id").agg(F.min("person_id").alias("by_id__"))
    local = people.filter("tmdb_id is null").groupBy(F.lower(collapse(F.col("name"))).alias("key__")).agg(F.min("person_id").alias("by_name__"))
    rows = asked.withColumn("key__", F.lower(collapse(F.col("name")))).join(by_id, "tmdb_id", "left").join(local, "key__", "left")
    return rows.withColumn("person_id", F.coalesce("by_id__", "by_name__")).drop("by_id__", "by_name__", "key__")


def watch_and_unwant(watches: DataFrame, wants: DataFrame, incoming: DataFrame, user: str, movie: str, overwrite: bool = True) -> tuple[DataFrame, DataFrame]:
    """(watches, wants): what is marked as watched is no longer wanted."""
    return mark_watched(watches, incoming, user, movie, overwrite), remove(wants, incoming, [user, movie])


def longest(rows: DataFrame, keys: Sequence[str], text: str, position: str) -> DataFrame:
    """The row with the longest text of each key, the first of equally long ones."""
    whole = F.struct(*[c for c in rows.columns if c not in keys])
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(F.length(F.coalesce(text, F.lit(""))), -F.col(position))).alias("best__"))
    return best.select(*keys, "best__.*")
