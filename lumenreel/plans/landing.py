"""Landed records, blends of sources and statistics of runs, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.operators import blending as B
from lumenreel.plans.base import query, table
from lumenreel.sources import dimensions as D
from lumenreel.sources import runs

_TEXT = "CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'text ' || repeat('x', (l_orderkey % 60)::INT) END"


@query("source_blend", f"""WITH r AS (SELECT l_partkey AS movie_id, l_suppkey % 3 AS rank, l_orderkey * 8 + l_linenumber AS pos, l_quantity, l_tax, l_returnflag AS f, l_linestatus AS s, strftime(l_shipdate, '%Y-%m') AS m, {_TEXT} AS txt, l_extendedprice AS tie FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY rank, pos, tie) AS n FROM r),
t AS (SELECT movie_id, first(txt ORDER BY n) FILTER (WHERE txt <> '') AS own, first(txt ORDER BY len(txt) DESC, n) FILTER (WHERE txt <> '') AS best FROM o GROUP BY 1),
u AS (SELECT movie_id, string_agg(f || s, ',' ORDER BY n) AS names FROM (SELECT movie_id, f, s, min(n) AS n FROM o GROUP BY 1, 2, 3) GROUP BY 1),
v AS (SELECT movie_id, count(DISTINCT m) AS n_events FROM o GROUP BY 1)
SELECT movie_id, own AS title, CASE WHEN len(best) > len(own) + 40 THEN best ELSE own END AS overview, best AS note, names, n_events FROM t JOIN u USING (movie_id) JOIN v USING (movie_id)""")
def source_blend(spark, sf_dir):
    """Line items as records of films from three sources, each film as one: texts by rank and length, lists and events united in order."""
    key, n = F.col("l_orderkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    text = F.when(key % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("text "), F.repeat(F.lit("x"), (key % 60).cast("int"))))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("movie_id"), (F.col("l_suppkey") % 3).alias("rank"), (n.cast("double") * 1e6 + F.col("l_extendedprice")).alias("position"), F.rtrim(text).alias("title"), F.rtrim(text).alias("overview"), F.rtrim(text).alias("note"),
        F.array(F.concat("l_returnflag", "l_linestatus")).alias("names"), F.array(F.struct(F.date_format("l_shipdate", "yyyy-MM").alias("day"))).alias("events"),
    )
    out = B.blend(rows, ["movie_id"], B.Blend(first=["title"], longer={"overview": 40}, longest=["note"], union=["names"], events={"events": ["day"]}))
    return out.select("movie_id", "title", "overview", "note", F.array_join("names", ",").alias("names"), F.size("events").cast("long").alias("n_events"))


def _landed(spark, sf_dir):
    """Parts as landed records of films, their brands as crews; every ninth is cut off, every eleventh has a text for a number."""
    i, none = F.col("p_partkey"), F.lit(None).cast("string")
    person = lambda n, job: F.struct(n.cast("bigint").alias("id"), F.concat(F.lit("Person "), n.cast("string")).alias("name"), (n % 3).cast("int").alias("gender"), none.alias("profile_path"), F.lit(job).alias("job"), F.lit(None).cast("int").alias("order"))
    crew = F.array(person(F.substring("p_brand", 7, 9).cast("bigint"), "Director"), person(i % 7 + 100, "Editor"), person(i % 5 + 1, "Director"))
    record = F.to_json(F.struct(i.alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("runtime"), F.array(F.struct(F.col("p_type").alias("name"))).alias("genres"), F.struct(crew.alias("crew")).alias("credits")))
    cut = F.when(i % 9 == 0, F.substring(record, F.lit(1), F.length(record) - 5)).when(i % 11 == 0, F.regexp_replace(record, r'"runtime":\d+', '"runtime":"long"')).otherwise(record)
    return D.checked(table(spark, sf_dir, "part").select(cut.alias("value")), D.FILM)


@query("landed_films", "SELECT p_partkey AS tmdb_id, p_name AS title, CASE WHEN p_size > 0 THEN p_size END AS runtime, p_type AS genres, CASE WHEN substr(p_brand, 7) = (p_partkey % 5 + 1)::VARCHAR THEN 'Person ' || substr(p_brand, 7) ELSE 'Person ' || substr(p_brand, 7) || ', Person ' || (p_partkey % 5 + 1) END AS director FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0")
def landed_films(spark, sf_dir):
    """Films of the good records."""
    return D.films(_landed(spark, sf_dir)[0]).select("tmdb_id", "title", "runtime", "genres", "director")


@query("landed_bad", "SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 9 = 0) AS n_cut FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 11 = 0")
def landed_bad(spark, sf_dir):
    """Records that were set aside."""
    return _landed(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.endswith("value", F.lit("}"))).alias("n_cut"))


@query("landed_credits", "SELECT tmdb_id, person_tmdb_id, row_number() OVER (PARTITION BY tmdb_id ORDER BY min(pl)) - 1 AS billing FROM (SELECT p_partkey AS tmdb_id, substr(p_brand, 7)::BIGINT AS person_tmdb_id, 0 AS pl FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, p_partkey % 5 + 1, 2 FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 11 <> 0) GROUP BY 1, 2")
def landed_credits(spark, sf_dir):
    """Directors of films as a bridge table."""
    return D.film_credits(_landed(spark, sf_dir)[0]).select("tmdb_id", "person_tmdb_id", F.col("billing").cast("long").alias("billing"))


@query("run_statistics", "SELECT count(*) AS raw, count(*) FILTER (WHERE l_quantity >= 10) AS parsed, count(*) FILTER (WHERE l_quantity < 10) AS failed, count(DISTINCT CASE WHEN l_quantity >= 10 THEN (l_partkey, l_suppkey, l_shipdate) END) AS written FROM lineitem")
def run_statistics(spark, sf_dir):
    """Counts of an ingest of all line items, taken while they are written (to nowhere)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("movie_id"), F.col("l_suppkey").alias("theater_id"), F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("quantity"))
    parse = lambda df: df.withColumn("start", F.when(F.col("quantity") >= 10, F.col("at")))
    stats = runs.run(rows, parse, lambda df: df.dropDuplicates(["movie_id", "theater_id", "start"]), lambda df: df.write.format("noop").mode("overwrite").save(), "all")
    return spark.createDataFrame([tuple(stats[c] for c in ("raw", "parsed", "failed", "written"))], "raw long, parsed long, failed long, written long")
