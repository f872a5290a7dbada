"""CSV imports of watched films: two exports with different headers, delimiters and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D

# Columns of each export by role; the first that is there and not empty counts.
ALIASES = {
    "title": ["title", "name", "标题"],
    "year": ["year"],
    "directors": ["directors", "director"],
    "rating": ["rating", "个人评分"],
    "watched": ["watcheddate", "watched date", "date", "打分日期"],
    "review": ["review", "我的短评"],
    "released": ["上映日期"],
    "countries": ["制片国家"],
    "link": ["letterboxduri", "letterboxd uri", "url", "条目链接"],
    "tmdb_id": ["tmdbid"],
    "imdb": ["imdbid"],
    "poster": ["封面"],
}
DOUBAN, LETTERBOXD = {"标题", "条目链接"}, {"letterboxduri", "title"}


def header_name(name: str) -> str:
    return " ".join(name.replace("﻿", "").strip().lower().split())


def provider(columns: list[str]) -> str | None:
    names = set(map(header_name, columns))
    return "douban" if names >= DOUBAN else "letterboxd" if names >= LETTERBOXD else None


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export: the delimiter is what the first line has more of; quoted fields may span lines, short rows have nulls."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0].value if head else ""
    by = "\t" if line.count("\t") > line.count(",") else ","
    rows = spark.read.csv(path, header=True, sep=by, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", encoding="UTF-8")
    return rows.toDF(*map(header_name, rows.columns))


def normalized(rows: DataFrame) -> DataFrame:
    """provider, title, candidates, year, directors, rating, watched_at, review, links and ids of every row that has a title."""
    kind = provider(rows.columns)
    if kind is None:
        raise ValueError(f"no known export has the columns {rows.columns}")

    def of(role: str) -> Column:
        held = [F.nullif(T.collapse(F.col(f"`{c}`")), F.lit("")) for c in ALIASES[role] if c in rows.columns]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    names = T.split_list(of("title"), r"\s*/\s*") if kind == "douban" else F.array(of("title"))
    halves = F.regexp_extract(of("rating"), r"^\s*([\d.]+)\s*/\s*10\s*$", 1).try_cast("double") / 2
    out = rows.select(
        F.lit(kind).alias("provider"), F.try_element_at(names, F.lit(1)).alias("title"), names.alias("candidates"),
        F.coalesce(of("year").try_cast("int"), N.year(of("released"))).alias("year"), of("directors").alias("directors"),
        N.rating(F.coalesce(halves.cast("string"), of("rating"))).alias("rating"), D.noon_of(of("watched")).alias("watched_at"), of("review").alias("review"),
        T.words(of("review")).alias("review_words"), of("countries").alias("countries"), T.canonical_url(of("link")).alias("link"),
        of("tmdb_id").try_cast("int").alias("tmdb_id"), T.imdb_id(of("imdb")).alias("imdb"), of("poster").alias("poster"),
    )
    return out.filter(F.col("title").isNotNull() & (F.col("title") != ""))


def outcome(rows: DataFrame) -> DataFrame:
    """Counts of an import over its ``outcome`` column."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("imported", "updated", "skipped", "failed")])
