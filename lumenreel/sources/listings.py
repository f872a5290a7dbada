"""Landed listings (JSON, iCalendar, HTML, inline scripts) as rows of scraped showtimes.

Fetching is a landing job outside Spark: it writes raw responses as files or
rows. Each reader takes a DataFrame with a text column and never visits rows one
by one; ``READERS`` finds the reader of a source's format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D

#: Columns of a scraped showtime.
SCRAPED = ["movie_title", "shown_title", "start_raw", "ticket_url", "source_url", "raw_format", "source_showtime_id", "director", "year", "runtime", "overview", "poster_url"]
FREE = "FREE"


def scraped(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as scraped showtimes; what a source lacks is null, rows without title or start go."""
    kinds = {"year": "int", "runtime": "int"}
    rows = df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in SCRAPED], *[v.alias(k) for k, v in columns.items() if k not in SCRAPED])
    return rows.filter((F.coalesce("movie_title", F.lit("")) != "") & (F.coalesce("start_raw", F.lit("")) != ""))


def land(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their paths, as landed."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


MOVIES_JSON = "array<struct<title:string,director:string,year:int,runtime:int,showdates:array<struct<date:string,showtypes:array<struct<type:string,showtimes:array<struct<id:string,date_time:string,url:string>>>>>>>>"


def nested_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """Movies with dates with types with times: three levels exploded."""
    m = raw.select(F.explode(F.from_json(body, MOVIES_JSON)).alias("m"))
    d = m.select("m", F.explode("m.showdates").alias("d")).select("m", "d", F.explode("d.showtypes").alias("t")).select("m", "d", "t", F.explode("t.showtimes").alias("s"))
    return scraped(d, movie_title=T.clean(F.col("m.title")), start_raw=F.coalesce("s.date_time", "d.date"), ticket_url=F.col("s.url"), raw_format=F.col("t.type"), source_showtime_id=F.col("s.id"), director=F.col("m.director"), year=F.col("m.year"), runtime=F.col("m.runtime"))


FILM_JSON = "struct<title:string,slug:string,showtimes:array<struct<id:string,date:string,time:string,venue:string,ticketsUrl:string,freeEvent:boolean>>>"


def film_json(raw: DataFrame, venues: Sequence[str], details: DataFrame | None = None, body: str = "body") -> DataFrame:
    """One film a record; showtimes of other venues go; ``details`` (slug, year, runtime, director, overview, poster_url) enrich by left join."""
    s = raw.select(F.from_json(body, FILM_JSON).alias("f")).select("f", F.explode("f.showtimes").alias("s")).filter(F.col("s.venue").isin(*venues))
    s = s.withColumn("slug", F.col("f.slug"))
    fields = ["year", "runtime", "director", "overview", "poster_url"]
    s = s.join(details, "slug", "left") if details is not None else s.select("*", *[F.lit(None).cast("string").alias(c) for c in fields])
    free = F.coalesce("s.freeEvent", F.lit(False))
    return scraped(s, movie_title=T.clean(F.col("f.title")), start_raw=F.concat_ws(" ", "s.date", "s.time"), ticket_url=F.when(free, FREE).otherwise(F.col("s.ticketsUrl")), source_showtime_id=F.col("s.id"), **{c: F.col(c) for c in fields})


def calendar(raw: DataFrame, category: str | None = "screening", body: str = "body") -> DataFrame:
    """Events of iCalendar files: folded lines joined, events split, one category kept; ``start`` is UTC."""
    flat = F.regexp_replace(F.regexp_replace(body, r"\r\n?", "\n"), r"\n[ \t]", "")
    events = raw.select(F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), F.lit(1))).alias("e"))
    line = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1), F.lit(""))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\n"), F.lit(" ")), F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";")), F.lit("\\\\"), F.lit("\\"))
    zone = F.nullif(F.regexp_extract("e", r"(?m)^DTSTART[^:\n]*TZID=([^:;\n]+)", 1), F.lit(""))
    kept = events.filter(F.exists(T.split_list(line("CATEGORIES")), lambda x: F.lower(x) == category)) if category else events
    start = D.ics_time(line("DTSTART"), zone)
    return scraped(kept, movie_title=T.clean(T.decode_entities(plain(line("SUMMARY")))), start_raw=D.iso_utc(start), source_url=line("URL"), overview=T.clean(T.html_text(plain(line("DESCRIPTION")))), source_showtime_id=line("UID"), start=start)


JSON_LD = "struct<`@type`:string,name:string,startDate:string,url:string,image:string,description:string,offers:struct<url:string>>"


def json_ld(raw: DataFrame, body: str = "body") -> DataFrame:
    """Events in the JSON-LD scripts of pages, single or in arrays."""
    scripts = F.regexp_extract_all(body, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    one = raw.select(F.explode(scripts).alias("j")).withColumn("j", F.trim("j"))
    listed = F.when(F.startswith("j", F.lit("[")), F.from_json("j", f"array<{JSON_LD}>")).otherwise(F.array(F.from_json("j", JSON_LD)))
    e = one.select(F.explode(listed).alias("e")).filter(F.rlike("e.`@type`", F.lit("Event$")))
    return scraped(e, movie_title=T.clean(T.decode_entities(F.col("e.name"))), start_raw=F.col("e.startDate"), ticket_url=F.coalesce("e.offers.url", "e.url"), source_url=F.col("e.url"), poster_url=F.col("e.image"), overview=T.html_text(F.col("e.description")))


def markup(raw: DataFrame, item: str, fields: dict[str, str], body: str = "body", page_url: str | None = None) -> DataFrame:
    """Repeated blocks of pages: ``item`` matches a block (group 1), ``fields`` give a pattern (group 1) for each column; texts lose their markup."""
    blocks = raw.select(*([page_url] if page_url else []), F.explode(F.regexp_extract_all(body, F.lit(item), F.lit(1))).alias("b"))
    found = {name: F.regexp_extract("b", pattern, 1) for name, pattern in fields.items()}
    texts = {name: F.nullif(c if name.endswith("_url") else T.clean(T.html_text(c)), F.lit("")) for name, c in found.items()}
    if "raw_format" not in texts and "meta" in texts:
        parsed = N.meta(texts["meta"])
        texts |= {"year": parsed.year, "runtime": parsed.runtime, "raw_format": parsed.format}
    texts.pop("meta", None)
    return scraped(blocks, **texts, **({"source_url": F.col(page_url)} if page_url and "source_url" not in texts else {}))


def script_payloads(raw: DataFrame, key: str, schema: str, body: str = "body") -> DataFrame:
    """Objects under a key in scripts that push escaped JSON text; ``schema`` is theirs."""
    pushed = F.regexp_extract_all(body, F.lit(r'self\.__next_f\.push\(\[\d+,"((?:[^"\\]|\\.)*)"\]\)'), F.lit(1))
    text = F.from_json(F.concat(F.lit('{"t":"'), F.array_join(pushed, ""), F.lit('"}')), "t string").t
    return raw.select(F.explode(F.from_json(F.regexp_extract(text, rf'(?s)"{key}":(\[.*?\])(?=[,}}]"|[,}}]\s*$|,"|\}})', 1), f"array<{schema}>")).alias("x")).select("x.*")


def enrich(rows: DataFrame, details: DataFrame, on: str, fill: Sequence[str]) -> DataFrame:
    """Detail pages by address, each looked up once; they fill what a listing lacks."""
    once = details.groupBy(on).agg(*[F.first(c, ignorenulls=True).alias(f"{c}__") for c in fill])
    return rows.join(once, on, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"{c}__")) for c in fill}).select(rows.columns)


READERS: dict[str, Callable[..., DataFrame]] = {"nested_json": nested_json, "film_json": film_json, "calendar": calendar, "json_ld": json_ld, "markup": markup}


def reader(kind: str) -> Callable[..., DataFrame]:
    if kind not in READERS:
        raise KeyError(f"no reader for {kind}; there are {', '.join(READERS)}")
    return READERS[kind]
