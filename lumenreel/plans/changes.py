"""Snapshot changes and stateful jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.operators import jobs as J
from lumenreel.operators import predicates as P
from lumenreel.operators import relational as R
from lumenreel.operators import snapshots as S
from lumenreel.plans.base import NOW, movies, posts, query, showtimes, table, wants
from lumenreel.plans.serving import POSTS, UP, on_screen

#: Two snapshots of showtimes: what was stored is all but the last ship dates, what came in all but the first.
LATE, EARLY = "1999-06-01", "1997-06-01"


def _slots(spark, sf_dir):
    """One row for each (movie, theater, start): the key of a showtime."""
    rows = showtimes(spark, sf_dir).groupBy("movie_id", "theater_id", "start").agg(F.max("status").alias("status"), F.max("format").alias("format"))
    return rows.withColumn("fingerprint", F.sha2(F.concat_ws("|", "movie_id", "theater_id", F.date_format("start", "yyyy-MM-dd")), 256))


_SLOTS = "(SELECT l_partkey AS movie_id, l_suppkey AS theater_id, l_shipdate AS start, max(l_linestatus) AS status, max(l_returnflag) AS format, sha256(l_partkey || '|' || l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d')) AS fingerprint FROM lineitem GROUP BY 1, 2, 3)"


@query("upsert_snapshot", f"""
WITH s AS (SELECT fingerprint, format, 'O' AS status FROM {_SLOTS} WHERE start < TIMESTAMP '{LATE}' AND status <> 'X'), o AS (SELECT fingerprint, format, status FROM {_SLOTS} WHERE start < TIMESTAMP '{LATE}'),
i AS (SELECT fingerprint, lower(format) AS format FROM {_SLOTS} WHERE start >= TIMESTAMP '{EARLY}')
SELECT fingerprint, coalesce(i.format, o.format) AS format, CASE WHEN i.fingerprint IS NOT NULL THEN 'SCHEDULED' ELSE o.status END AS status FROM o FULL JOIN i USING (fingerprint)""")
def upsert_snapshot(spark, sf_dir):
    """Incoming showtimes over the stored ones; whatever came in is scheduled again."""
    rows = _slots(spark, sf_dir)
    stored = rows.filter(F.col("start") < P.moment(LATE)).select("fingerprint", "format", "status")
    incoming = rows.filter(F.col("start") >= P.moment(EARLY)).select("fingerprint", F.lower("format").alias("format"))
    return S.upsert(stored, incoming, ["fingerprint"], reset={"status": F.lit("SCHEDULED")})


@query("tombstone_missing", f"""
WITH s AS (SELECT * FROM {_SLOTS}), c AS (SELECT fingerprint FROM s WHERE format = 'N')
SELECT fingerprint, CASE WHEN theater_id <= 50 AND start >= TIMESTAMP '{NOW}' AND start <= TIMESTAMP '{NOW}' + INTERVAL 120 DAY AND status = 'O' AND NOT EXISTS (SELECT 1 FROM c WHERE c.fingerprint = s.fingerprint) THEN 'CANCELED' ELSE status END AS status FROM s""")
def tombstone_missing(spark, sf_dir):
    """Scheduled showtimes of some theaters within 120 days that the current listing lacks."""
    rows = _slots(spark, sf_dir)
    return S.tombstone_missing(rows, rows.filter("format = 'N'"), "fingerprint", F.col("theater_id") <= 50, "start", "status", NOW, scheduled="O").select("fingerprint", "status")


@query("insert_ignore", "WITH a AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2), b AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def insert_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    stored = R.keep_first(rows.filter(F.col("event_type").isin("view", "click")), ["user_id", "event_type"], ["event_id"])
    return S.insert_ignore(stored, rows.filter(F.col("event_type").isin("click", "error")), ["user_id", "event_type"], ["event_id"])


@query("expired", f"SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS movie_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT coalesce(CASE WHEN p_size > 5 THEN l_shipdate + to_minutes(p_size) END < TIMESTAMP '{NOW}' OR (p_size <= 5 AND l_shipdate < TIMESTAMP '{NOW}'), FALSE)")
def expired(spark, sf_dir):
    """What stays after expiry; short movies have no end."""
    rows = showtimes(spark, sf_dir).join(movies(spark, sf_dir).select("movie_id", "runtime"), "movie_id")
    end = F.when(F.col("runtime") > 5, F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("runtime")))
    gone = P.expired(F.col("start"), F.col("end"), NOW)
    return rows.withColumn("end", end).filter(~F.coalesce(gone, F.lit(False))).select("order_id", "line", "movie_id")


@query("backfill_end", "SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS movie_id, strftime(CASE WHEN l_returnflag = 'N' THEN l_shipdate ELSE l_shipdate + to_minutes(p_size) END, '%Y-%m-%d %H:%M:%S') AS end_at FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A' UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'")
def backfill_end(spark, sf_dir):
    """N has an end, R gets one from the movie's runtime, A keeps its own runtime of 0 and gets none."""
    rows = showtimes(spark, sf_dir).join(movies(spark, sf_dir).select("movie_id", F.col("runtime").alias("movie_runtime")), "movie_id")
    rows = rows.withColumns({"end_at": F.when(F.col("format") == "N", F.col("start")), "runtime": F.when(F.col("format") == "A", F.lit(0))})
    done = S.backfill_end(rows, "start", "end_at", "runtime", "movie_runtime")
    return done.select("order_id", "line", "movie_id", F.date_format("end_at", "yyyy-MM-dd HH:mm:ss").alias("end_at"))


@query("orphan_cleanup", "SELECT c_custkey AS user_id FROM customer WHERE c_acctbal >= 0 OR c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT user_id FROM events)")
def orphan_cleanup(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("external"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    return S.without_orphans(users, "user_id", "external", orders, table(spark, sf_dir, "events").select("user_id")).select("user_id")


@query("table_counts", "SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_scheduled, count(*) FILTER (WHERE l_linestatus = 'F') AS n_canceled, count(DISTINCT l_partkey) AS n_movies, count(DISTINCT l_suppkey) AS n_theaters, count(DISTINCT l_returnflag) AS n_formats FROM lineitem")
def table_counts(spark, sf_dir):
    rows = showtimes(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "O").alias("n_scheduled"), F.count_if(F.col("status") == "F").alias("n_canceled"), F.countDistinct("movie_id").alias("n_movies"), F.countDistinct("theater_id").alias("n_theaters"), F.countDistinct("format").alias("n_formats"))


@query("canonical_theater", "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END || '-' || c_nationkey AS slug, c_acctbal AS updated FROM customer) SELECT lower(slug) AS slug, id, min(id) OVER (PARTITION BY lower(slug)) AS position FROM c QUALIFY row_number() OVER (PARTITION BY lower(slug) ORDER BY slug = lower(slug) DESC, updated DESC NULLS LAST, id DESC) = 1")
def canonical_theater(spark, sf_dir):
    segment = F.when(F.col("c_acctbal") > 5000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws("-", segment, F.col("c_nationkey").cast("string")).alias("slug"), F.col("c_acctbal").alias("updated"), F.col("c_custkey").alias("position"))
    return S.canonical_by_slug(rows, "slug", "updated", "id").select("slug", "id", "position")


@query("fold_theaters", "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS slug, c_acctbal AS updated FROM customer), k AS (SELECT lower(slug) AS s, id FROM c QUALIFY row_number() OVER (PARTITION BY lower(slug) ORDER BY slug = lower(slug) DESC, updated DESC NULLS LAST, id DESC) = 1) SELECT o_orderkey AS order_id, k.id FROM orders JOIN c ON c.id = o_custkey JOIN k ON k.s = lower(c.slug)")
def fold_theaters(spark, sf_dir):
    """Child rows pointed at the theater that stays."""
    segment = F.when(F.col("c_acctbal") > 5000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), segment.alias("slug"), F.col("c_acctbal").alias("updated"), F.col("c_custkey").alias("position"))
    children = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("id"))
    return S.fold_by_slug(rows, children, "slug", "updated", "id", "id")[1].select("order_id", "id")


@query("replace_bridge", "WITH b AS (SELECT DISTINCT o_custkey AS movie_id, l_partkey AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), i AS (SELECT DISTINCT o_custkey AS movie_id, l_partkey AS tag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') SELECT * FROM b WHERE movie_id NOT IN (SELECT movie_id FROM i) UNION ALL SELECT * FROM i")
def replace_bridge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("movie_id"), "o_orderstatus")
    rows = showtimes(spark, sf_dir).select("order_id", F.col("movie_id").alias("tag")).join(orders, "order_id")
    of = lambda s: rows.filter(F.col("o_orderstatus") == s).select("movie_id", "tag").distinct()
    return S.replace_children(of("F"), of("P"), "movie_id")


@query("close_posts", f"SELECT post_id, CASE WHEN type = 'SELL' AND showtime_id < 10 THEN 'CLOSED' ELSE status END AS status, CASE WHEN type = 'SELL' AND showtime_id < 10 THEN CASE WHEN status = 'CLOSED' THEN '2023-12-31 00:00' ELSE '1998-06-01 00:00' END WHEN status = 'CLOSED' THEN '2023-12-31 00:00' END AS closed_at FROM {POSTS}")
def close_posts(spark, sf_dir):
    rows = posts(spark, sf_dir).withColumn("closed_at", F.when(F.col("status") == "CLOSED", F.lit("2023-12-31").cast("timestamp_ntz")))
    asked = rows.filter("type = 'SELL' and showtime_id < 10").select("post_id")
    return S.close_posts(rows, asked, "post_id", NOW).select("post_id", "status", F.date_format("closed_at", "yyyy-MM-dd HH:mm").alias("closed_at"))


@query("market_match", f"WITH p AS (SELECT * FROM {POSTS}) SELECT a.post_id AS trigger_id, b.post_id AS recipient_id, a.showtime_id FROM p a JOIN p b ON a.showtime_id = b.showtime_id AND a.user_id <> b.user_id AND a.type <> b.type WHERE a.status = 'ACTIVE' AND b.status = 'ACTIVE' AND NOT (a.post_id < 2000 AND b.post_id < 2000)")
def market_match(spark, sf_dir):
    """All active posts against all posts of the other side; pairs of early posts were notified."""
    rows = posts(spark, sf_dir)
    early = rows.filter("post_id < 2000")
    notified = J.matches(early, early, spark.createDataFrame([], "trigger_id long, recipient_id long"))
    return J.matches(rows, rows, notified)


_WANTS = "(SELECT DISTINCT o_custkey AS user_id, l_partkey AS movie_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
_USERS = "(SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS email FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')"


def _users(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_name")).alias("email"), "c_mktsegment")
    settings = rows.filter("c_mktsegment in ('MACHINERY', 'BUILDING')").select("user_id", (F.col("c_mktsegment") != "MACHINERY").alias("enabled"))
    return J.reachable(rows.select("user_id", "email"), settings)


def _shown(spark, sf_dir):
    return on_screen(spark, sf_dir).withColumn("showtime_id", F.concat_ws("-", "order_id", "line", "theater_id", "format"))


_FIRST2 = f"(SELECT movie_id, string_agg(id, ',' ORDER BY start, id) AS showtimes FROM (SELECT l_partkey AS movie_id, l_shipdate AS start, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_returnflag AS id FROM lineitem WHERE {UP} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_returnflag) <= 2) GROUP BY 1)"


def _told(items):
    return items.select("user_id", "movie_id", F.array_join(F.transform("showtimes", lambda x: x.showtime_id), ",").alias("showtimes"))


@query("reminder_transition", f"SELECT w.user_id, w.movie_id, f.showtimes FROM {_WANTS} w JOIN {_USERS} u USING (user_id) JOIN {_FIRST2} f USING (movie_id) WHERE w.movie_id >= 100 AND NOT EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = w.user_id AND l.l_partkey = w.movie_id AND o.o_orderstatus = 'P')")
def reminder_transition(spark, sf_dir):
    """Wants with movie ids below 100 were made while on screen; those of P orders were delivered."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    delivered = showtimes(spark, sf_dir).select("order_id", "movie_id").join(orders, "order_id").select("user_id", "movie_id")
    flagged = wants(spark, sf_dir).withColumn("added_while_on_screen", F.col("movie_id") < 100)
    return _told(J.reminder_transition(flagged, _shown(spark, sf_dir), delivered, _users(spark, sf_dir)))


@query("reminder_summary", f"SELECT w.user_id, w.movie_id, f.showtimes FROM {_WANTS} w JOIN {_USERS} u USING (user_id) JOIN {_FIRST2} f USING (movie_id) WHERE w.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def reminder_summary(spark, sf_dir):
    """Users with a signup event had this day's summary."""
    signups = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", F.lit("1998-06-05").alias("date_key"))
    return _told(J.reminder_summary(wants(spark, sf_dir), _shown(spark, sf_dir), signups, _users(spark, sf_dir), "1998-06-05"))


@query("director_transition", f"WITH f AS (SELECT DISTINCT user_id, p_brand AS person_id FROM {_WANTS} JOIN part ON p_partkey = movie_id) SELECT DISTINCT f.user_id, f.person_id, p_partkey AS movie_id, u.email FROM f JOIN part ON p_brand = f.person_id JOIN {_USERS} u USING (user_id) WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE {UP}) AND NOT EXISTS (SELECT 1 FROM {_WANTS} w WHERE w.user_id = f.user_id AND w.movie_id = p_partkey)")
def director_transition(spark, sf_dir):
    """Users follow the people of movies they want; those movies were delivered, the others of the same people are due."""
    credits = movies(spark, sf_dir).select(F.col("person").alias("person_id"), "movie_id")
    wanted = wants(spark, sf_dir).join(credits, "movie_id")
    follows = wanted.select("user_id", "person_id").distinct()
    return J.director_transition(follows, credits, on_screen(spark, sf_dir), wanted, _users(spark, sf_dir)).select("user_id", "person_id", "movie_id", "email")


@query("reminder_digest", f"SELECT user_id, email, count(*) AS n_items, string_agg(movie_id::VARCHAR, ',' ORDER BY movie_id) AS movies FROM {_WANTS} JOIN {_USERS} USING (user_id) JOIN {_FIRST2} f USING (movie_id) GROUP BY 1, 2")
def reminder_digest(spark, sf_dir):
    items = J.reminder_summary(wants(spark, sf_dir), _shown(spark, sf_dir), spark.createDataFrame([], "user_id long, date_key string"), _users(spark, sf_dir), "1998-06-05")
    return J.digests(items).select("user_id", "email", "n_items", F.array_join(F.transform("items", lambda x: x.movie_id.cast("string")), ",").alias("movies"))


@query("initial_flags", f"SELECT user_id, movie_id, movie_id IN (SELECT l_partkey FROM lineitem WHERE {UP}) AS added_while_on_screen FROM {_WANTS}")
def initial_flags(spark, sf_dir):
    rows = wants(spark, sf_dir).withColumn("added_while_on_screen", F.lit(None).cast("boolean"))
    return S.initial_flags(rows, on_screen(spark, sf_dir), "movie_id").select("user_id", "movie_id", "added_while_on_screen")


@query("add_wants", f"WITH a AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS movie_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), b AS (SELECT * FROM {_WANTS}) SELECT *, NULL::BOOLEAN AS added_while_on_screen FROM a UNION ALL SELECT b.*, b.movie_id IN (SELECT l_partkey FROM lineitem WHERE {UP}) FROM b ANTI JOIN a USING (user_id, movie_id)")
def add_wants(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    stored = showtimes(spark, sf_dir).select("order_id", "movie_id").join(orders, "order_id").select("user_id", "movie_id").distinct().withColumn("added_while_on_screen", F.lit(None).cast("boolean"))
    return S.add_wants(stored, wants(spark, sf_dir), on_screen(spark, sf_dir), "user_id", "movie_id")


@query("mark_watched", "WITH s AS (SELECT o_custkey AS user_id, min(o_totalprice) AS rating FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), i AS (SELECT user_id, CASE WHEN max(value) > 50 THEN max(value) END AS rating FROM events GROUP BY 1) SELECT user_id, 1::BIGINT AS movie_id, coalesce(s.rating, i.rating) AS rating FROM s FULL JOIN i USING (user_id)")
def mark_watched(spark, sf_dir):
    """An import: ratings that are there stay."""
    stored = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_totalprice").alias("rating")).withColumn("movie_id", F.lit(1).cast("long"))
    incoming = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("v")).select("user_id", F.lit(1).cast("long").alias("movie_id"), F.when(F.col("v") > 50, F.col("v")).alias("rating"))
    return S.mark_watched(stored, incoming, "user_id", "movie_id", overwrite=False)
