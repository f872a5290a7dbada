"""Entity resolution over parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.operators import merging as M
from lumenreel.operators import relational as R
from lumenreel.operators import resolution as E
from lumenreel.plans.base import movies, query, showtimes, table, wants


def _films(spark, sf_dir):
    """Parts as movies: large sizes are external ids, types ending in Y have posters, brands direct, sizes give years."""
    rows = movies(spark, sf_dir).select("movie_id", "title", F.col("genre").alias("original_title"), F.col("person").alias("director"), (F.col("runtime") + 1960).alias("year"), F.when(F.col("runtime") > 40, F.col("runtime")).alias("tmdb_id"), F.when(F.endswith("genre", F.lit("Y")), F.col("genre")).alias("poster"), F.lit(None).cast("string").alias("imdb"), F.lit(None).cast("array<string>").alias("links"))
    return E.with_keys(rows)


def _probes(spark, sf_dir):
    """One probe for each title, with the brand and size of its first part."""
    first = R.keep_first(_films(spark, sf_dir), ["title_key"], ["movie_id"])
    return first.select(F.col("movie_id").alias("probe_id"), F.array("title_key").alias("keys"), "director_key", "year", F.lit(None).cast("int").alias("tmdb_id"), F.lit(None).cast("string").alias("imdb"), F.array().cast("array<string>").alias("links"))


_SCORED = """
f AS (SELECT p_partkey AS movie_id, lower(p_name) AS k, lower(p_type) AS o, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS d, p_size + 1960 AS y, CASE WHEN p_size > 40 THEN p_size END AS t, CASE WHEN p_type LIKE '%Y' THEN p_type END AS p FROM part),
q AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY movie_id) = 1),
x AS (SELECT q.movie_id AS probe_id, f.movie_id, q.d AS qd, f.d AS fd, q.y AS qy, f.y AS fy,
  (100 + CASE WHEN q.d = f.d OR contains(q.d, f.d) OR contains(f.d, q.d) THEN 40 ELSE -20 END + CASE abs(q.y - f.y) WHEN 0 THEN 25 WHEN 1 THEN 10 ELSE -20 END + CASE WHEN f.t IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN f.p IS NOT NULL THEN 5 ELSE 0 END)::INTEGER AS score
  FROM q JOIN f ON q.k = f.k)"""


@query("match_score", f"WITH {_SCORED} SELECT probe_id, movie_id, score FROM x")
def match_score(spark, sf_dir):
    """Every part against the probe of its title."""
    probes, films = _probes(spark, sf_dir), _films(spark, sf_dir)
    rows = E.candidates(probes, films, False).join(probes.select("probe_id", "keys", F.col("director_key").alias("pd"), F.col("year").alias("py")), "probe_id").join(films, "movie_id")
    score = E.match_score(F.col("keys"), F.col("pd"), F.col("py"), F.col("title_key"), F.col("original_title_key"), F.col("director_key"), F.col("year"), F.col("tmdb_id"), F.col("poster"))
    return rows.select("probe_id", "movie_id", score.alias("score"))


@query("best_match", f"WITH {_SCORED} SELECT probe_id, movie_id, score FROM x WHERE (qd = fd OR contains(qd, fd) OR contains(fd, qd)) AND abs(qy - fy) <= 1 AND score >= 90 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, movie_id) = 1")
def best_match(spark, sf_dir):
    probes, films = _probes(spark, sf_dir), _films(spark, sf_dir)
    return E.best_matches(probes, films, E.candidates(probes, films, True), E.EXACT_MIN)


_CASCADE = """
f AS (SELECT p_partkey AS movie_id, lower(p_name) AS k, lower(p_type) AS o, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS d, p_size + 1960 AS y, CASE WHEN p_size > 40 THEN p_partkey END AS t, CASE WHEN p_type LIKE '%Y' THEN p_type END AS p,
  CASE WHEN p_size BETWEEN 25 AND 40 THEN 'tt' || p_partkey END AS imdb, CASE WHEN p_size < 25 THEN 'https://example.org/film/' || p_partkey || '/about' END AS link FROM part),
q AS (SELECT movie_id AS id, CASE WHEN movie_id % 5 = 4 THEN regexp_replace(k, ' [^ ]+$', '') ELSE k END AS k, d, y, CASE WHEN movie_id % 5 = 0 THEN movie_id END AS t, CASE WHEN movie_id % 5 = 1 THEN 'tt' || movie_id END AS imdb, CASE WHEN movie_id % 5 = 2 THEN 'https://example.org/film/' || movie_id END AS link FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY movie_id) = 1)),
a AS (SELECT id, min(movie_id) AS movie_id FROM q JOIN f USING (t) GROUP BY 1),
b AS (SELECT id, min(movie_id) AS movie_id FROM q JOIN f USING (imdb) WHERE id NOT IN (SELECT id FROM a) GROUP BY 1),
c AS (SELECT id, min(movie_id) AS movie_id FROM q JOIN f ON starts_with(f.link, q.link) WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b) GROUP BY 1),
r AS (SELECT * FROM q WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c)),
x AS (SELECT r.id, f.movie_id, r.k = f.k OR r.k = f.o AS exact, (CASE WHEN r.k = f.k THEN 100 WHEN r.k = f.o THEN 95 WHEN contains(r.k, f.k) OR contains(f.k, r.k) OR contains(r.k, f.o) OR contains(f.o, r.k) THEN 35 ELSE 0 END
  + 40 + CASE abs(r.y - f.y) WHEN 0 THEN 25 ELSE 10 END + CASE WHEN f.t IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN f.p IS NOT NULL THEN 5 ELSE 0 END)::INTEGER AS score
  FROM r JOIN f ON (contains(r.k, f.k) OR contains(f.k, r.k) OR contains(r.k, f.o) OR contains(f.o, r.k)) AND (r.d = f.d OR contains(r.d, f.d) OR contains(f.d, r.d)) AND abs(r.y - f.y) <= 1 AND (r.k = f.k OR r.k = f.o OR length(r.k) >= 4 OR contains(r.k, ' '))),
d AS (SELECT id, movie_id FROM x WHERE exact AND score >= 90 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, movie_id) = 1),
e AS (SELECT id, movie_id FROM x WHERE score >= 60 AND id NOT IN (SELECT id FROM d) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, movie_id) = 1)"""


@query("match_cascade", f"WITH {_CASCADE} SELECT id AS probe_id, movie_id, 'tmdb_id' AS via FROM a UNION ALL SELECT *, 'imdb' FROM b UNION ALL SELECT *, 'link' FROM c UNION ALL SELECT *, 'title' FROM d UNION ALL SELECT *, 'loose_title' FROM e")
def match_cascade(spark, sf_dir):
    """Probes with an external id, a title id, the beginning of an address, a whole title, or one without its last word; each stage has some to decide."""
    id_text, size, fifth = F.col("movie_id").cast("string"), F.col("runtime"), F.col("movie_id") % 5
    address = F.concat(F.lit("https://example.org/film/"), id_text)
    none = F.array().cast("array<string>")
    rows = movies(spark, sf_dir).withColumns({"original_title": F.col("genre"), "director": F.col("person"), "year": size + 1960, "tmdb_id": F.when(size > 40, F.col("movie_id")), "poster": F.when(F.endswith("genre", F.lit("Y")), F.col("genre"))})
    rows = rows.withColumns({"imdb": F.when(size.between(25, 40), F.concat(F.lit("tt"), id_text)), "links": F.when(size < 25, F.array(F.concat(address, F.lit("/about")))).otherwise(none)})
    films = E.with_keys(rows)
    first = R.keep_first(films, ["title_key"], ["movie_id"])
    key = F.when(fifth == 4, F.regexp_replace("title_key", " [^ ]+$", "")).otherwise(F.col("title_key"))
    probes = first.select(F.col("movie_id").alias("probe_id"), F.array(key).alias("keys"), "director_key", "year", F.when(fifth == 0, F.col("movie_id")).alias("tmdb_id"), F.when(fifth == 1, F.concat(F.lit("tt"), id_text)).alias("imdb"), F.when(fifth == 2, F.array(F.upper(address))).otherwise(none).alias("links"))
    return E.match(probes, films)


_TARGET = "(CASE WHEN p_size > 40 THEN 2000 ELSE 0 END + 120 + 70 + CASE WHEN p_type LIKE '%Y' THEN 20 ELSE 0 END + least(coalesce(n, 0), 25) + 50)"
_PLAN = f"r AS (SELECT lower(p_name) AS title_key, p_partkey AS k, CASE WHEN p_size > 40 THEN p_size END AS t, {_TARGET} AS score, row_number() OVER (PARTITION BY lower(p_name) ORDER BY {_TARGET} DESC, p_partkey) AS place FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def _plan(spark, sf_dir):
    shown = showtimes(spark, sf_dir).groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _films(spark, sf_dir).join(shown, "movie_id", "left")
    score = E.target_score(F.lit(None).cast("int"), F.col("tmdb_id"), F.lit(True), F.col("original_title"), F.col("imdb"), F.col("poster"), F.col("n"), E.suspicious(F.col("title"), F.col("title")))
    rows = rows.withColumns({"score": score, "n_directors": F.size(E.person_names(F.col("director")))})
    return E.merge_plan(rows, "title_key", "movie_id", "tmdb_id", "score", "n_directors")


@query("merge_plan", f"WITH {_PLAN} SELECT title_key, CASE WHEN count(DISTINCT t) > 1 THEN 'conflict' ELSE 'merge' END AS kind, CASE WHEN count(DISTINCT t) <= 1 THEN min(k) FILTER (WHERE place = 1) END AS target, count(*) AS n_rows, CASE WHEN count(DISTINCT t) <= 1 THEN coalesce(string_agg(k::VARCHAR, ',' ORDER BY t IS NOT NULL, k) FILTER (WHERE place > 1), '') END AS sources FROM r GROUP BY 1")
def merge_plan(spark, sf_dir):
    return _plan(spark, sf_dir).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query("merge_conflict", f"WITH {_PLAN} SELECT title_key, count(*) AS n_rows FROM r GROUP BY 1 HAVING count(DISTINCT t) > 1")
def merge_conflict(spark, sf_dir):
    return _plan(spark, sf_dir).filter("kind = 'conflict'").select("title_key", "n_rows")


_MOVES = "m AS (SELECT p_partkey AS source, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS target FROM part QUALIFY p_partkey <> min(p_partkey) OVER (PARTITION BY p_brand, p_size))"


def _moves(spark, sf_dir):
    """Parts of one brand and size merge into the first of them."""
    first = F.min("movie_id").over(R.Window.partitionBy("person", "runtime"))
    return movies(spark, sf_dir).select(F.col("movie_id").alias("source"), first.alias("target")).filter("source <> target")


@query("merge_wants", f"WITH {_MOVES}, w AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS movie_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), r AS (SELECT user_id, coalesce(target, movie_id) AS movie_id, CASE WHEN movie_id > 50 THEN movie_id > 100 END AS flag, target IS NOT NULL AS moved, movie_id AS was FROM w LEFT JOIN m ON source = movie_id) SELECT user_id, movie_id, first(flag ORDER BY moved, was) FILTER (WHERE flag IS NOT NULL) AS added_while_on_screen FROM r GROUP BY 1, 2")
def merge_wants(spark, sf_dir):
    """Wants after a merge: what a user wanted twice folds."""
    rows = wants(spark, sf_dir).withColumn("added_while_on_screen", F.when(F.col("movie_id") > 50, F.col("movie_id") > 100))
    return M.merge_wants(rows, _moves(spark, sf_dir)).select("user_id", "movie_id", "added_while_on_screen")


@query("merge_watches", f"WITH {_MOVES}, w AS (SELECT o_custkey AS user_id, l_partkey AS movie_id, max(l_quantity) AS words, min(o_orderdate) AS day, CASE WHEN max(l_quantity) > 25 THEN max(l_quantity) END AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT user_id, coalesce(target, movie_id) AS movie_id, max(words) AS review_words, strftime(min(day), '%Y-%m-%d') AS watched_at, first(rating ORDER BY target IS NOT NULL, movie_id) FILTER (WHERE rating IS NOT NULL) AS rating FROM w LEFT JOIN m ON source = movie_id GROUP BY 1, 2")
def merge_watches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    rows = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").groupBy("user_id", F.col("l_partkey").alias("movie_id")).agg(F.max("l_quantity").alias("review_words"), F.min("at").alias("watched_at"), F.when(F.max("l_quantity") > 25, F.max("l_quantity")).alias("rating"))
    return M.merge_watches(rows, _moves(spark, sf_dir)).select("user_id", "movie_id", "review_words", F.date_format("watched_at", "yyyy-MM-dd").alias("watched_at"), "rating")


@query("merge_ledger", f"WITH {_MOVES} SELECT DISTINCT o_custkey AS user_id, coalesce(target, l_partkey) AS movie_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN m ON source = l_partkey")
def merge_ledger(spark, sf_dir):
    return M.merge_ledger(wants(spark, sf_dir), _moves(spark, sf_dir), "movie_id", ["user_id", "movie_id"])


@query("survivorship", "SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, CASE WHEN c_acctbal > 0 THEN c_name END, c_mktsegment) AS title, coalesce(CASE WHEN s_nationkey <> 0 THEN s_nationkey END, CASE WHEN c_nationkey <> 0 THEN c_nationkey END) AS runtime FROM supplier JOIN customer ON c_custkey = s_suppkey")
def survivorship(spark, sf_dir):
    """Suppliers as stored rows, customers of the same key as what came in; empty texts and zeros are missing."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("s_suppkey"))
    title = E.survivor(F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(""), F.when(F.col("c_acctbal") > 0, F.col("c_name")), F.col("c_mktsegment"))
    return rows.select(F.col("s_suppkey").alias("id"), title.alias("title"), E.survivor(F.col("s_nationkey"), F.col("c_nationkey")).alias("runtime"))


@query("surviving_date", "SELECT o_orderkey AS id, strftime(CASE WHEN o_orderstatus <> 'P' AND (o_orderpriority LIKE '1%' OR strftime(o_orderdate, '%m-%d') = '01-01') THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END, '%Y-%m-%d') AS released FROM orders")
def surviving_date(spark, sf_dir):
    """P orders lack an external date; urgent ones are local rows."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    external = F.when(F.col("o_orderstatus") != "P", at + F.expr("INTERVAL '40' DAY"))
    released = E.surviving_date(at, F.when(~F.startswith("o_orderpriority", F.lit("1")), 1), external, F.lit(None).cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(released, "yyyy-MM-dd").alias("released"))


@query("fingerprint", "SELECT l_orderkey AS order_id, l_linenumber AS line, sha256(lower(s_name) || '|' || lower(p_name) || '|' || strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000Z|' || lower(l_returnflag)) AS fingerprint FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def fingerprint(spark, sf_dir):
    theaters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("theater_id"), "s_name")
    titled = E.with_keys(movies(spark, sf_dir).select("movie_id", "title"), titles=("title",)).select("movie_id", "title")
    rows = showtimes(spark, sf_dir).join(titled, "movie_id").join(theaters, "theater_id")
    return rows.select("order_id", "line", E.fingerprint(F.col("s_name"), F.col("title"), F.col("start"), F.col("format")).alias("fingerprint"))


@query("one_edit_names", "WITH n AS (SELECT DISTINCT p_brand AS n FROM part) SELECT x.n AS a, y.n AS b FROM n x JOIN n y ON x.n < y.n AND levenshtein(x.n, y.n) <= 1")
def one_edit_names(spark, sf_dir):
    return E.one_edit_pairs(movies(spark, sf_dir), "person")


@query("names_within", "WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT DISTINCT lower(p_name) AS n FROM part) SELECT w, n FROM w JOIN n ON contains(n, w)")
def names_within(spark, sf_dir):
    """Words of titles within titles."""
    titles = movies(spark, sf_dir).select(F.lower("title").alias("n")).distinct()
    parts = titles.select(F.explode(F.split("n", " ")).alias("w")).distinct()
    return E.containing_pairs(parts, titles, "w", "n", ("w", "n")).distinct()
