"""Text, number and time functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D
from lumenreel.functions.titles import with_parsed
from lumenreel.plans.base import movies, query, table

_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0085}\x0B]+"
_CLEAN = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ')"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("clean_text", f"SELECT doc_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS n FROM documents")
def clean_text(spark, sf_dir):
    c = T.clean(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n"))


def _nested_replace(column: str) -> str:
    for entity, text in T.ENTITIES:
        column = f"replace({column}, '{entity}', '{text}')"
    return column


@query("html_entities", f"SELECT page_id, md5({_nested_replace('html')}) AS digest FROM pages")
def html_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("digest"))


@query("name_keys", f"SELECT doc_id, md5(trim(regexp_replace(replace(strip_accents(lower({_CLEAN})), '''', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS digest FROM documents")
def name_keys(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.name_key(T.clean(F.col("text")))).alias("digest"))


@query("slugs", f"SELECT doc_id, md5(regexp_replace(regexp_replace(strip_accents(lower(trim(text, ' '))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS digest FROM documents")
def slugs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.slug(F.col("text"))).alias("digest"))


@query("word_count", f"SELECT doc_id, CASE WHEN {_CLEAN} = '' THEN 0 ELSE len(string_split({_CLEAN}, ' ')) END::INTEGER AS n FROM documents")
def word_count(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("n"))


@query("program_flag", f"SELECT doc_id, regexp_matches(lower({_CLEAN}), '{'|'.join(T.PROGRAM_WORDS)}') AS titled FROM documents")
def program_flag(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.program_title(F.col("text")).alias("titled"))


@query("format_names", "SELECT p_partkey AS movie_id, CASE WHEN p_size % 3 = 0 THEN '35mm' WHEN p_size % 3 = 1 THEN '4K DCP' ELSE 'Standard' END AS stored, CASE WHEN p_size % 3 = 0 THEN '35mm' WHEN p_size % 3 = 1 THEN '4K DCP' END AS found FROM part")
def format_names(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("New "), F.col("p_name"), F.lit(" 35mm print"))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_name"), F.lit(" in 4k DCP"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), N.normal_format(raw).alias("stored"), N.find_format(raw).alias("found"))


@query("meta_line", "SELECT p_partkey AS movie_id, 1950 + p_size AS year, p_size + 60 AS runtime, CASE WHEN p_size % 2 = 0 THEN '16mm' END AS format, p_brand AS other FROM part")
def meta_line(spark, sf_dir):
    """Year, runtime, format and the rest of a listing's comma-separated line."""
    raw = F.concat_ws(", ", F.col("p_brand"), (F.col("p_size") + 1950).cast("string"), F.concat((F.col("p_size") + 60).cast("string"), F.lit(" min.")), F.when(F.col("p_size") % 2 == 0, F.lit("16 mm")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("movie_id"), N.meta(raw, ",").alias("m")).select("movie_id", "m.year", "m.runtime", "m.format", "m.other")


@query("title_grammar")
def title_grammar(spark, sf_dir):
    """The grammar over every line of each document and over movie titles with the types of events added as notes."""
    lines = _documents(spark, sf_dir).select("doc_id", F.lit(None).cast("long").alias("movie_id"), F.posexplode_outer(F.split("text", "\n")).alias("line", "raw"))
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    titled = movies(spark, sf_dir).crossJoin(F.broadcast(kinds)).select(F.lit(None).cast("long").alias("doc_id"), "movie_id", F.lit(None).cast("int").alias("line"), F.concat("title", F.lit(" - Q&A after "), "event_type").alias("raw"))
    return with_parsed(lines.unionByName(titled), "raw").select("doc_id", "movie_id", "line", "parsed.title", "parsed.year", "parsed.format", "parsed.note", F.size("parsed.candidates").alias("n_candidates"))


@query("json_explode", "SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events)")
def json_explode(spark, sf_dir):
    """Each property of an event as a row."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


_NY = "ts - INTERVAL 5 HOUR"


@query("ny_datekey", f"SELECT event_id, strftime({_NY}, '%Y-%m-%d') AS day, strftime({_NY}, '%H:%M') AS clock FROM events")
def ny_datekey(spark, sf_dir):
    """Local day and clock (these events are all in winter)."""
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", D.local_day(ts).alias("day"), D.local_clock(ts).alias("clock"))


@query("year_infer", "WITH d AS (SELECT o_orderkey AS id, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders), y AS (SELECT id, y, abs(date_diff('day', DATE '1998-06-01', try_cast(y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE))) AS far FROM d, (VALUES (1997), (1998), (1999)) t(y)) SELECT id, y::INTEGER AS year FROM d LEFT JOIN (SELECT id, y FROM y WHERE far IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, y) = 1) USING (id)")
def year_infer(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), D.nearest_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), "1998-06-01 12:00:00").alias("year"))


@query("start_parse", "SELECT o_orderkey AS id, strftime(CASE WHEN o_orderdate >= (CASE year(o_orderdate) WHEN 1995 THEN TIMESTAMP '1995-04-02' WHEN 1996 THEN TIMESTAMP '1996-04-07' WHEN 1997 THEN TIMESTAMP '1997-04-06' WHEN 1998 THEN TIMESTAMP '1998-04-05' WHEN 1999 THEN TIMESTAMP '1999-04-04' WHEN 2000 THEN TIMESTAMP '2000-04-02' ELSE TIMESTAMP '2001-04-01' END) AND o_orderdate < (CASE year(o_orderdate) WHEN 1995 THEN TIMESTAMP '1995-10-29' WHEN 1996 THEN TIMESTAMP '1996-10-27' WHEN 1997 THEN TIMESTAMP '1997-10-26' WHEN 1998 THEN TIMESTAMP '1998-10-25' WHEN 1999 THEN TIMESTAMP '1999-10-31' WHEN 2000 THEN TIMESTAMP '2000-10-29' ELSE TIMESTAMP '2001-10-28' END) THEN date_trunc('day', o_orderdate) + INTERVAL '23 hours 30 minutes' ELSE date_trunc('day', o_orderdate) + INTERVAL '24 hours 30 minutes' END, '%Y-%m-%d %H:%M') AS start FROM orders")
def start_parse(spark, sf_dir):
    """Texts like "Friday, April 10, 1998 7:30 PM" back to UTC."""
    raw = F.concat(F.date_format("o_orderdate", "EEEE, MMMM d, yyyy"), F.lit(" 7:30 PM"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(D.parse_start(raw, "1998-06-01 12:00:00"), "yyyy-MM-dd HH:mm").alias("start"))


@query("ratings", "SELECT event_id, CASE WHEN v BETWEEN 0 AND 5 AND v * 2 = floor(v * 2) THEN v END AS rating FROM (SELECT event_id, round(value / 10, 1) AS v FROM events)")
def ratings(spark, sf_dir):
    raw = F.round(F.col("value") / 10, 1).cast("string")
    return table(spark, sf_dir, "events").select("event_id", N.rating(raw).alias("rating"))


@query("canonical_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '\\?.*$|#.*$', ''), '/+$', '') AS url FROM pages")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url"), drop_query=True).alias("url"))
