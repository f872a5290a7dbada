"""Fields of showtimes, posts, people and pages, and scores of search results, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D
from lumenreel.operators import jobs as J
from lumenreel.operators import predicates as P
from lumenreel.operators import resolution as E
from lumenreel.operators import snapshots as S
from lumenreel.plans.base import EVENTS_NOW, movies, ny_sql, posts, query, showtimes, table
from lumenreel.plans.serving import POSTS

_AT = "(l_shipdate + INTERVAL (l_linenumber * 5) HOUR)"


@query("showtime_fields", f"""SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS movie_id, l_linenumber % 3 = 0 AND (l_linenumber % 2 = 1 OR p_size > 25) AS needs_end,
CASE WHEN l_linenumber % 2 = 0 THEN p_name || ' live' ELSE '' END AS shown, l_returnflag = 'A' AS free, '$' || format('{{:,.2f}}', l_quantity * 1234 / 100) AS price, strftime({ny_sql(_AT)}, '%a, %b %-d at %-I:%M %p') AS mail FROM lineitem JOIN part ON p_partkey = l_partkey""")
def showtime_fields(spark, sf_dir):
    """Whether an end is missing and could be filled, the title to show, whether it is free, a price and the day in a mail."""
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").join(movies(spark, sf_dir).withColumnRenamed("movie_id", "l_partkey"), "l_partkey")
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), line * 5)
    end = F.when(line % 3 != 0, at)
    return rows.select(
        F.col("l_orderkey").alias("order_id"), line.alias("line"), F.col("l_partkey").alias("movie_id"), F.coalesce(P.needs_end(end, F.when(line % 2 == 1, 90), F.when(F.col("runtime") > 25, F.col("runtime"))), F.lit(False)).alias("needs_end"),
        T.display_title(F.when(line % 2 == 0, F.concat("title", F.lit("  live"))).otherwise(F.upper("title")), F.col("title")).alias("shown"), T.is_free(F.when(F.col("l_returnflag") == "A", F.lit(" free "))).alias("free"),
        N.price_label((F.col("l_quantity") * 1234).cast("int")).alias("price"), D.mail_label(at).alias("mail"),
    )


@query("post_sides", f"SELECT post_id, CASE type WHEN 'BUY' THEN 'SELL' ELSE 'BUY' END AS other, least(greatest(floor(value)::INT, 1), 20) AS quantity FROM {POSTS}")
def post_sides(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", N.other_side(F.col("type")).alias("other"), N.clamp(F.floor("value").cast("string"), 1, 20, 1).alias("quantity"))


def _pairs(spark, sf_dir):
    """Each part beside the one after it, as what is looked for and what a search gave."""
    rows = movies(spark, sf_dir)
    other = rows.select((F.col("movie_id") - 1).alias("movie_id"), *[F.col(c).alias(f"{c}_2") for c in ("title", "genre", "person", "runtime")])
    return rows.join(other, "movie_id")


_SCORED = """
x AS (SELECT a.p_partkey AS movie_id, a.p_name AS t, split_part(b.p_name, ' ', (b.p_partkey % 3 + 1)::INT) AS c0, b.p_name AS bn, lower(b.p_type) AS o, substr(a.p_brand, 7) AS d, substr(b.p_brand, 7) AS e, a.p_size AS y, b.p_size AS z FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT *, CASE WHEN movie_id % 4 = 0 THEN t WHEN movie_id % 4 = 1 THEN split_part(t, ' ', 1) ELSE bn END AS c FROM x),
p AS (SELECT *, CASE WHEN t = c THEN 90 WHEN t = o THEN 80 WHEN contains(c, t) OR contains(t, c) OR contains(o, t) OR contains(t, o) THEN 35 ELSE 0 END + CASE WHEN contains(d, e) OR contains(e, d) THEN 60 ELSE -20 END + CASE WHEN y = z THEN 55 WHEN abs(y - z) = 1 THEN 20 WHEN abs(y - z) = 2 THEN 8 ELSE -20 END
  + CASE WHEN abs(y - z) * 3 <= 2 THEN 12 WHEN abs(y - z) * 3 <= 5 THEN 6 WHEN abs(y - z) * 3 >= 20 THEN -10 ELSE 0 END AS score,
  CASE movie_id % 7 WHEN 0 THEN 40 WHEN 1 THEN 26 WHEN 2 THEN 16 WHEN 3 THEN 10 WHEN 4 THEN 5 ELSE 0 END + CASE WHEN movie_id % 7 = 0 AND y % 5 + 1 = 1 THEN 35 WHEN movie_id % 7 = 0 AND y % 5 + 1 <= 3 THEN 12 ELSE 0 END AS bonus FROM s)"""


@query("search_scores", f"""WITH {_SCORED} SELECT movie_id, score::INT AS score, bonus::INT AS bonus, score + bonus >= CASE WHEN y > 25 THEN 95 ELSE 80 END OR (t = c AND score + bonus >= 88) OR (t = o AND score + bonus >= 75) OR (y % 5 = 0 AND NOT y > 25 AND score + bonus >= 70) AS sure FROM p""")
def search_scores(spark, sf_dir):
    """How well a search result fits: by title, people, year and length, by its rank, and whether that is enough."""
    i, y = F.col("movie_id"), F.col("runtime")
    rows = _pairs(spark, sf_dir).withColumn("c", F.when(i % 4 == 0, F.col("title")).when(i % 4 == 1, F.substring_index("title", " ", 1)).otherwise(F.col("title_2")))
    who, other = F.substring("person", 7, 9), F.substring("person_2", 7, 9)
    score = E.search_score(F.col("title"), F.col("c"), F.lower("genre_2"), who, other, y, F.col("runtime_2"), y * 3, F.col("runtime_2") * 3)
    rows = rows.withColumns({"score": score, "bonus": E.rank_bonus((i % 7).cast("int"), y % 5 + 1)})
    total = F.col("score") + F.col("bonus")
    sure = E.confident(total, y > 25, F.col("title") == F.col("c"), F.col("title") == F.lower("genre_2"), y % 5 == 0)
    return rows.select("movie_id", "score", "bonus", sure.alias("sure"))


@query("people_agree", """WITH n AS (SELECT a.p_partkey AS movie_id, split_part(a.p_name, ' ', 1) AS f, split_part(a.p_name, ' ', 2) AS l, split_part(b.p_name, ' ', 1) AS g, split_part(b.p_name, ' ', 2) AS m, b.p_size AS z FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
k AS (SELECT *, (contains(l, m) OR contains(m, l) OR levenshtein(l, m) <= 1) AND (starts_with(f, g) OR starts_with(g, f) OR (least(len(f), len(g)) >= 3 AND substr(f, 1, least(len(f), len(g), 4)) = substr(g, 1, least(len(f), len(g), 4)))) AS fits FROM n)
SELECT movie_id, l || ':' || substr(f, 1, 4) || '|zee:cy' AS signature, fits OR z % 3 = 0 AS agree FROM k""")
def people_agree(spark, sf_dir):
    """Titles read as names: whether two lists of people could be the same, and a list's signature."""
    first = F.concat(F.lit("Directed by "), F.initcap("title"), F.lit(", Cy Zee"))
    second = F.when(F.col("runtime_2") % 3 == 0, F.lit("")).otherwise(F.initcap("title_2"))
    return _pairs(spark, sf_dir).select("movie_id", E.people_signature(first).alias("signature"), E.people_match(E.person_names(first), E.person_names(second)).alias("agree"))


@query("token_lifetimes", f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, md5(event_id::VARCHAR) DESC) AS k FROM events) WHERE k = 1 AND value >= 5 AND ts + INTERVAL 240 HOUR > TIMESTAMP '{EVENTS_NOW}'")
def token_lifetimes(spark, sf_dir):
    """Events as tokens: the last one of each user, if it is not used and young enough."""
    ts = F.col("ts").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", ts.alias("created_at"), F.when(F.col("value") < 5, ts).alias("used_at"), F.md5(F.col("event_id").cast("string")).alias("token_hash"))
    return J.live_tokens(rows, EVENTS_NOW, 240).select("event_id")


@query("link_fills", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://a/' || s_suppkey ELSE c_name END AS imdb, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE c_mktsegment END AS page FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey")
def link_fills(spark, sf_dir):
    """Suppliers with the links that customers of their key bring, where theirs are empty."""
    i = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").select(i.alias("id"), F.when(i % 3 == 0, F.concat(F.lit("https://a/"), i.cast("string"))).when(i % 3 == 1, F.lit("")).alias("imdb"), F.when(i % 2 == 0, F.col("s_name")).alias("page"))
    coming = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("imdb"), F.col("c_mktsegment").alias("page"))
    return S.fill_links(stored, coming, "id", ["imdb", "page"])


_CAME = f"(SELECT user_id, showtime_id, type, floor(value * 3)::INT AS quantity, floor(value * 100)::INT AS cents FROM {POSTS} WHERE post_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY user_id, showtime_id, type ORDER BY post_id) = 1)"
_HELD = f"(SELECT user_id, showtime_id, type, status, 1 AS quantity, 500 AS cents FROM {POSTS} WHERE post_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, showtime_id, type ORDER BY post_id) = 1)"
_VALID = f"(SELECT * FROM {_CAME} WHERE quantity BETWEEN 1 AND 100 AND showtime_id % 5 <> 0)"


def _posted(spark, sf_dir):
    first = lambda rest: F.row_number().over(Window.partitionBy("user_id", "showtime_id", "type").orderBy("post_id"))
    rows = posts(spark, sf_dir).withColumn("part", F.col("post_id") % 3)
    once = lambda n: rows.filter(F.col("part") == n).withColumn("k", first(n)).filter("k = 1")
    none = F.lit(None).cast("timestamp_ntz")
    held = once(0).select("user_id", "showtime_id", "type", "status", F.lit(1).alias("quantity"), F.lit(500).alias("price_cents"), F.lit("a").alias("seat_info"), none.alias("closed_at"), "updated_at")
    came = once(1).select("user_id", "showtime_id", "type", F.floor(F.col("value") * 3).cast("int").alias("quantity"), F.floor(F.col("value") * 100).cast("int").alias("price_cents"), F.lit("b").alias("seat_info"))
    open_ = F.when(F.col("showtime_id") % 5 == 0, "CANCELED").otherwise("SCHEDULED")
    shows = rows.select("showtime_id").distinct().select("showtime_id", F.lit("2030-01-01").cast("timestamp_ntz").alias("start"), open_.alias("status"))
    return S.upsert_posts(held, came, shows, EVENTS_NOW)


@query("post_upsert", f"SELECT coalesce(c.user_id, h.user_id) AS user_id, coalesce(c.showtime_id, h.showtime_id) AS showtime_id, coalesce(c.type, h.type) AS type, CASE WHEN c.type IS NOT NULL THEN 'ACTIVE' ELSE h.status END AS status, coalesce(c.quantity, h.quantity) AS quantity, CASE WHEN c.type IS NULL THEN h.cents WHEN c.type = 'SELL' THEN c.cents END AS price_cents FROM {_HELD} h FULL JOIN {_VALID} c USING (user_id, showtime_id, type)")
def post_upsert(spark, sf_dir):
    """Posts that come in over those there are: only for open showtimes, with a price only where something is sold."""
    return _posted(spark, sf_dir)[0].select("user_id", "showtime_id", "type", "status", "quantity", "price_cents")


@query("post_triggers", f"SELECT user_id, showtime_id, type FROM {_VALID} c WHERE NOT EXISTS (SELECT 1 FROM {_HELD} h WHERE h.user_id = c.user_id AND h.showtime_id = c.showtime_id AND h.type = c.type AND h.status = 'ACTIVE')")
def post_triggers(spark, sf_dir):
    """Those of them that are new or active again."""
    return _posted(spark, sf_dir)[1].select("user_id", "showtime_id", "type")


@query("page_texts", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&nbsp;', ' '), '[\s ]+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_texts(spark, sf_dir):
    """The text of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


@query("contact_fields", r"""SELECT c_custkey AS id, replace(replace(replace(c_name || '<' || c_mktsegment || '&''', '&', '&amp;'), '<', '&lt;'), '''', '&#39;') AS safe, lower(substr(c_mktsegment, 1, 1)) || '***@x.org' AS masked, lower(c_name) AS comparable,
lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'tt' || lpad(c_custkey::VARCHAR, 7, '0') END AS imdb, 'https://x.org/a/' || c_custkey AS link, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_unique FROM customer""")
def contact_fields(spark, sf_dir):
    """Escaped, masked, compared and linked texts of customers."""
    i = F.col("c_custkey").cast("string")
    name, kind = F.col("c_name"), F.col("c_mktsegment")
    several = F.when(F.col("c_custkey") % 3 == 0, F.array(name, F.concat(F.lit(" "), F.upper(name)))).when(F.col("c_custkey") % 3 == 1, F.array(name, kind, F.lit(""))).otherwise(F.array(F.lit(" ")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), T.escape_html(F.concat(name, F.lit("<"), kind, F.lit("&'"))).alias("safe"), T.mask_mail(F.concat(F.lit(" "), kind, F.lit("@x.org "))).alias("masked"),
        T.comparable(F.concat(F.lit("\\u0020"), name)).alias("comparable"), T.slug(name).alias("slug"), T.imdb_id(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://i/TT"), F.lpad(i, 7, "0")))).alias("imdb"),
        T.absolute_url(F.concat(F.lit("/a/"), i), "https://x.org/b/c").alias("link"), F.size(T.unique_texts(several)).alias("n_unique"),
    )
