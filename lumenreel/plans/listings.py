"""Small texts of listings: credits, overviews, days and times, market fields; built from stored values, so SQL knows what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.functions import listing as L
from lumenreel.plans.base import NOW, movies, ny_sql, query, showtimes, table


@query("director_texts", "SELECT p_partkey AS movie_id, CASE WHEN p_size % 7 = 6 THEN 'Unknown' ELSE p_brand END AS director FROM part")
def director_texts(spark, sf_dir):
    """Credits with what may stand behind the name."""
    tails = [" 1971, 90 min", " 101 Min.", "  4K DCP", " The First screening", " Winner of all", " presented by us", ""]
    name = F.element_at(F.array(*[F.concat(F.lit("Directed by  "), "person", F.lit(t)) for t in tails[:-1]], F.lit("directed by 1999")), (F.col("runtime") % 7 + 1).cast("int"))
    return movies(spark, sf_dir).select("movie_id", L.director_text(name).alias("director"))


@query("overview_meta", "SELECT p_partkey AS movie_id, CASE p_size % 3 WHEN 0 THEN (1950 + p_size)::VARCHAR || ' / ' || (60 + p_size) || 'min / 35mm' WHEN 1 THEN (60 + p_size) || 'min' ELSE '' END AS meta_line, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || (60 + p_size) || ' min' ELSE p_name END AS body, CASE p_size % 3 WHEN 0 THEN '35mm' ELSE '' END AS format FROM part")
def overview_meta(spark, sf_dir):
    size, minutes = F.col("runtime"), F.concat((F.col("runtime") + 60).cast("string"), F.lit(" min"))
    raw = F.when(size % 3 == 0, F.concat_ws(" ", "person", (size + 1950).cast("string"), minutes, F.lit("35mm"), "title")).when(size % 3 == 1, F.concat_ws("  ", "title", minutes)).otherwise(F.col("title"))
    return movies(spark, sf_dir).select("movie_id", L.overview_meta(raw).alias("m")).select("movie_id", "m.meta_line", "m.body", "m.format")


@query("date_labels", "SELECT o_orderkey AS id, strftime(o_orderdate, '%A, %B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS label FROM orders")
def date_labels(spark, sf_dir):
    raw = F.concat(F.lit(" <b>"), F.date_format("o_orderdate", "EEEE"), F.lit(" ,"), F.date_format("o_orderdate", "MMMM  d,yyyy"), F.lit("</b> "))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.date_label(raw).alias("label"))


@query("time_labels", "SELECT o_orderkey AS id, (CASE o_orderkey % 4 WHEN 0 THEN 1170 WHEN 1 THEN 0 WHEN 2 THEN 735 ELSE 1425 END)::INTEGER AS minutes FROM orders")
def time_labels(spark, sf_dir):
    """Spellings of times of day as minutes after midnight."""
    raw = F.element_at(F.array(*map(F.lit, ("7.30pm", "12 a.m.", " 12:15 P. M.", "23:45"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.time_of_day(raw).alias("minutes"))


@query("epoch_labels", f"SELECT l_orderkey AS order_id, l_linenumber AS line, strftime({ny_sql('l_shipdate')}, '%B ') || day({ny_sql('l_shipdate')}) || ', ' || year({ny_sql('l_shipdate')}) AS label FROM lineitem")
def epoch_labels(spark, sf_dir):
    """Local days of seconds since 1970."""
    seconds = F.unix_timestamp(F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    return showtimes(spark, sf_dir).select("order_id", "line", L.epoch_label(seconds).alias("label"))


@query("raw_labels", f"SELECT l_orderkey AS order_id, l_linenumber AS line, strftime({ny_sql('l_shipdate')}, '%A, %B ') || day({ny_sql('l_shipdate')}) || ', ' || year({ny_sql('l_shipdate')}) || ' ' || ltrim(strftime({ny_sql('l_shipdate')}, '%I:%M %p'), '0') AS label FROM lineitem")
def raw_labels(spark, sf_dir):
    return showtimes(spark, sf_dir).select("order_id", "line", L.raw_label(F.col("start")).alias("label"))


@query("safe_days", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '1998-06-01' END AS day FROM orders")
def safe_days(spark, sf_dir):
    """Days given by visitors: valid ones stay."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-13-dd"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.iso_day_or(raw, "1998-06-01").alias("day"))


@query("watched_days", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 12:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 08:15' END AS at, o_orderkey % 4 <> 3 AS valid FROM orders")
def watched_days(spark, sf_dir):
    raw = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T08:15:00.000Z'"), F.lit("  "), F.lit("soon")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), L.watched_at(raw).alias("w"))
    return rows.select("id", F.date_format("w.at", "yyyy-MM-dd HH:mm").alias("at"), "w.valid")


@query("active_days", f"SELECT o_orderkey AS id FROM orders WHERE o_orderdate::DATE BETWEEN {ny_sql(f'TIMESTAMP {chr(39)}{NOW} 00:00:00{chr(39)}')}::DATE AND ({ny_sql(f'TIMESTAMP {chr(39)}{NOW} 00:00:00{chr(39)}')} + INTERVAL 12 MONTH)::DATE")
def active_days(spark, sf_dir):
    """Events of the next twelve months."""
    return table(spark, sf_dir, "orders").filter(L.active_day(F.date_format("o_orderdate", "yyyy-MM-dd"), NOW)).select(F.col("o_orderkey").alias("id"))


@query("market_fields", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'BUY' WHEN event_type = 'purchase' THEN 'SELL' END AS type, CASE WHEN user_id % 2 = 0 THEN 'A MEMBER' ELSE 'user ' || user_id END AS name FROM events")
def market_fields(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", F.lit(" buy ")).when(F.col("event_type") == "purchase", F.lit("Sell")).otherwise(F.col("event_type"))
    name = F.when(F.col("user_id") % 4 == 0, F.lit("  ")).when(F.col("user_id") % 2 == 1, F.concat(F.lit(" user   "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", L.post_type(raw).alias("type"), L.display_name(name, "A MEMBER").alias("name"))
