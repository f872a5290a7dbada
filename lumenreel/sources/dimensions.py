"""Landed records of films and people: read against a schema, bad ones set aside, nested credits to bridge tables.

Fetching is a landing job: it writes one JSON record a line. A record that is no JSON,
or has a field of another kind, goes to the second output with its text and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse
from lumenreel.operators.relational import keep_first

CREDIT = "struct<id:bigint,name:string,gender:int,profile_path:string,job:string,order:int>"
FILM = (
    f"id bigint, title string, original_title string, release_date string, runtime int, overview string, imdb_id string, poster_path string, backdrop_path string, "
    f"genres array<struct<id:bigint,name:string>>, production_countries array<struct<name:string>>, credits struct<cast:array<{CREDIT}>,crew:array<{CREDIT}>>"
)
FILMED = "struct<id:bigint,title:string,original_title:string,release_date:string,poster_path:string,popularity:double,job:string>"
PERSON = f"id bigint, name string, gender int, profile_path string, movie_credits struct<crew:array<{FILMED}>>"
BAD = "_bad"


def image_url(path: Column, size: str = "w500", base: str = "https://image.tmdb.org/t/p") -> Column:
    """Address of an image; null without a path."""
    plain = F.trim(F.coalesce(path, F.lit("")))
    whole = F.rlike(plain, F.lit("^(?i)https?://"))
    return F.when(whole, plain).when(plain != "", F.concat(F.lit(f"{base}/{size}"), F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(F.lit("/"), plain))))


def checked(raw: DataFrame, schema: str, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good records with the columns of ``schema``, bad ones as they came); blank lines are neither. Other columns of ``raw`` stay with both."""
    others = [c for c in raw.columns if c != body]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = raw.filter(F.trim(F.coalesce(body, F.lit(""))) != "").withColumn("r__", F.from_json(body, f"{schema}, {BAD} string", options))
    bad = F.col(f"r__.{BAD}").isNotNull() | F.col("r__").isNull()
    return parsed.filter(~bad).select(*others, "r__.*").drop(BAD), parsed.filter(bad).select(*others, body)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed files with the file they stand in."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))


def films(good: DataFrame) -> DataFrame:
    """Films by external id; of several records of one the last file counts."""
    names = lambda c: F.nullif(F.array_join(F.filter(F.transform(F.col(c), lambda x: collapse(x["name"])), lambda x: x != ""), ", "), F.lit(""))
    last = keep_first(good.filter(F.col("id").isNotNull()), ["id"], [F.desc("file")] if "file" in good.columns else ["title"])
    people = F.filter(F.col("credits.crew"), lambda c: c["job"] == "Director")
    cast = F.slice(F.array_sort(F.transform(F.coalesce("credits.cast", F.array().cast(f"array<{CREDIT}>")), lambda c: F.struct(F.coalesce(c["order"], F.lit(1 << 30)).alias("o"), c["name"].alias("n")))), 1, 5)
    return last.select(
        F.col("id").alias("tmdb_id"), collapse(F.col("title")).alias("title"), F.nullif(collapse(F.col("original_title")), F.lit("")).alias("original_title"), F.try_to_date("release_date", "yyyy-MM-dd").alias("released"),
        F.when(F.col("runtime") > 0, F.col("runtime")).alias("runtime"), F.nullif(collapse(F.col("overview")), F.lit("")).alias("overview"), F.nullif(F.lower(F.trim("imdb_id")), F.lit("")).alias("imdb"),
        image_url(F.col("poster_path")).alias("poster"), image_url(F.col("backdrop_path"), "w1280").alias("backdrop"), names("genres").alias("genres"), names("production_countries").alias("countries"),
        F.nullif(F.array_join(F.array_distinct(F.transform(people, lambda c: collapse(c["name"]))), ", "), F.lit("")).alias("director"), F.nullif(F.array_join(F.transform(cast, lambda c: c.n), ", "), F.lit("")).alias("cast"),
    )


def film_credits(good: DataFrame, job: str = "Director", kind: str = "DIRECTOR") -> DataFrame:
    """(tmdb_id, person_tmdb_id, kind, billing): people of one job, once a film, in the order in which they are named."""
    crew = good.filter(F.col("id").isNotNull()).select(F.col("id").alias("tmdb_id"), F.posexplode("credits.crew").alias("at", "c")).filter(F.col("c.job") == job)
    named = crew.filter(collapse(F.col("c.name")) != "").select("tmdb_id", F.col("c.id").alias("person_tmdb_id"), "at")
    once = named.groupBy("tmdb_id", "person_tmdb_id").agg(F.min("at").alias("at"))
    return once.select("tmdb_id", "person_tmdb_id", F.lit(kind).alias("kind"), (F.row_number().over(Window.partitionBy("tmdb_id").orderBy("at", "person_tmdb_id")) - 1).alias("billing"))


def people(good_films: DataFrame, good_people: DataFrame) -> DataFrame:
    """(tmdb_id, name, gender, photo) of everyone with a record of their own or in a film's crew; own records first, then those of the smallest film."""
    own = good_people.filter(F.col("id").isNotNull()).select(F.col("id").alias("tmdb_id"), "name", "gender", "profile_path", F.lit(-1).cast("bigint").alias("of"))
    crew = good_films.select(F.col("id").alias("of"), F.explode("credits.crew").alias("c")).filter(F.col("c.id").isNotNull())
    every = own.unionByName(crew.select(F.col("c.id").alias("tmdb_id"), F.col("c.name").alias("name"), F.col("c.gender").alias("gender"), F.col("c.profile_path").alias("profile_path"), "of"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("of"))).alias(c)
    found = every.filter(collapse(F.col("name")) != "").groupBy("tmdb_id").agg(first("name"), first("gender"), first("profile_path"))
    return found.select("tmdb_id", collapse(F.col("name")).alias("name"), "gender", image_url(F.col("profile_path")).alias("photo"))


def filmographies(good_people: DataFrame, take: int = 10) -> DataFrame:
    """(person_tmdb_id, place, tmdb_id, title, year, poster): films a person directed, the most popular first, then the newest, then by title."""
    made = good_people.select(F.col("id").alias("person_tmdb_id"), F.explode("movie_credits.crew").alias("c")).filter((F.col("c.job") == "Director") & F.col("c.id").isNotNull() & (F.col("c.id") != 0))
    rows = made.select("person_tmdb_id", F.col("c.id").alias("tmdb_id"), F.coalesce(F.nullif("c.title", F.lit("")), F.nullif("c.original_title", F.lit("")), F.lit("Untitled")).alias("title"), F.year(F.try_to_date("c.release_date", "yyyy-MM-dd")).alias("year"), image_url(F.col("c.poster_path")).alias("poster"), F.col("c.popularity").alias("popularity"))
    once = keep_first(rows, ["person_tmdb_id", "tmdb_id"], [F.col("popularity").desc_nulls_last(), "title"])
    by = Window.partitionBy("person_tmdb_id").orderBy(F.coalesce("popularity", F.lit(0.0)).desc(), F.coalesce("year", F.lit(0)).desc(), F.collate("title", "UNICODE"), "tmdb_id")
    return once.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= take).select("person_tmdb_id", "place", "tmdb_id", "title", "year", "poster")
