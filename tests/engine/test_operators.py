"""Order-dependent shapes against plain loops, merges that lose nothing, jobs that deliver once, streams that match batches."""

import random

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import jobs as J
from lumenreel.operators import merging as M
from lumenreel.operators import relational as R
from lumenreel.operators import resolution as E
from lumenreel.operators import snapshots as S
from lumenreel.streaming import sinks


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_by_any_key(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "a", "b", "c", "d"]) or None, f"k{rng.randint(0, 12)}") for i in range(60)]
    seen, want = set(), []
    for i, a, b in rows:
        keys = {("a", a), ("b", b)} - {("a", None)}
        if not keys & seen:
            want.append(i)
            seen |= keys
    df = spark.createDataFrame(rows, "position int, a string, b string")
    keys = [F.concat(F.lit("a:"), "a"), F.concat(F.lit("b:"), "b")]
    assert sorted(r.position for r in R.dedupe_by_any_key(df, "position", keys).collect()) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_one_to_one(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.sample("abcdef", rng.randint(1, 3))) for i in range(15)]
    right = [(i, rng.sample("abcdef", rng.randint(1, 2))) for i in range(15)]
    used, want = set(), set()
    for i, keys in left:
        found = next((j for k in keys for j, ks in right if j not in used and k in ks), None)
        want.add((i, found))
        used.add(found)
    want |= {(None, j) for j, _ in right if j not in used}
    a, b = (spark.createDataFrame(x, "position int, keys array<string>") for x in (left, right))
    assert {tuple(r) for r in R.full_one_to_one(a, b, "keys", "keys").collect()} == want


def test_one_to_one_of_equal_rows(spark):
    """Many rows of one key on both sides are settled together, and a rare kind among them takes its turn."""
    left = [(i, ["k"] if i % 50 else ["z", "k"]) for i in range(400)]
    right = [(i, ["k"] if i % 97 else ["k", "z"]) for i in range(390)]
    used, want = set(), set()
    for i, keys in left:
        found = next((j for k in keys for j, ks in right if j not in used and k in ks), None)
        if found is not None:
            want.add((i, found))
            used.add(found)
    a, b = (spark.createDataFrame(x, "position int, keys array<string>") for x in (left, right))
    assert {tuple(r) for r in R.join_one_to_one(a, b, "keys", "keys").collect()} == want


def test_snapshots(spark):
    stored = spark.createDataFrame([("a", 1, "CANCELED"), ("b", 2, "SCHEDULED")], "k string, v int, status string")
    new = spark.createDataFrame([("a", 5), ("c", 6)], "k string, v int")
    once = S.upsert(stored, new, ["k"], reset={"status": F.lit("SCHEDULED")})
    assert sorted(map(tuple, once.collect())) == [("a", 5, "SCHEDULED"), ("b", 2, "SCHEDULED"), ("c", 6, "SCHEDULED")]
    assert sorted(map(tuple, S.upsert(once, new, ["k"], reset={"status": F.lit("SCHEDULED")}).collect())) == sorted(map(tuple, once.collect()))
    gone = S.tombstone_missing(spark.createDataFrame([("x", "2026-01-02"), (None, "2026-01-02"), ("y", "2026-09-01")], "k string, s string").select("k", F.col("s").cast("timestamp_ntz").alias("start"), F.lit("SCHEDULED").alias("status")), new, "k", F.lit(True), "start", "status", "2026-01-01")
    assert {r.k: r.status for r in gone.collect()} == {"x": "CANCELED", None: "SCHEDULED", "y": "SCHEDULED"}
    assert [r.n for r in R.numbered(spark.range(50), ["id"], "n", 10).orderBy("id").collect()] == list(range(11, 61))


def test_merges_conserve_rows(spark):
    moves = spark.createDataFrame([(2, 1), (3, 1)], "source long, target long")
    wants = spark.createDataFrame([("u", 1, None), ("u", 2, True), ("v", 3, False), ("w", 9, None)], "user_id string, movie_id long, added_while_on_screen boolean")
    assert sorted(map(tuple, M.merge_wants(wants, moves).collect()), key=str) == [("u", 1, True), ("v", 1, False), ("w", 9, None)]
    watches = spark.createDataFrame([("u", 1, None, 5, "2020"), ("u", 2, 0.0, 9, "2019")], "user_id string, movie_id long, rating double, review_words int, watched_at string")
    assert [tuple(r) for r in M.merge_watches(watches, moves).collect()] == [("u", 1, 0.0, 9, "2019")]
    shows = spark.createDataFrame([(10, 1, "f1", None, "t"), (11, 2, "f2", "Shown", None), (12, 3, None, None, None), (13, 3, None, "x", None)], "showtime_id long, movie_id long, fingerprint string, shown_title string, ticket_url string").withColumns({"source_url": F.lit(None).cast("string"), "source_showtime_id": F.lit("")})
    kept, pointers = M.merge_showtimes(shows, moves, F.when(F.col("fingerprint").isNotNull(), F.lit("f1")))
    assert sorted((r.showtime_id, r.movie_id, r.shown_title, r.ticket_url) for r in kept.collect()) == [(10, 1, "Shown", "t"), (12, 1, None, None), (13, 1, "x", None)]
    assert [tuple(r) for r in pointers.collect()] == [(11, 10)]
    posts = spark.createDataFrame([(1, "u", 10, "SELL", "CLOSED", 2, 0, None, 1000), (2, "u", 11, "SELL", "ACTIVE", 1, None, "A1", 2000)], "post_id long, user_id string, showtime_id long, type string, status string, quantity int, price_cents int, seat_info string, at long").withColumns({"closed_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.timestamp_seconds("at").cast("timestamp_ntz")})
    out = M.merge_posts(posts, pointers).collect()
    assert [(r.post_id, r.showtime_id, r.status, r.quantity, r.price_cents, r.seat_info) for r in out] == [(2, 10, "ACTIVE", 2, 0, "A1")]
    movies = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "movie_id long, tmdb_id int")
    fine, refused = M.checked_moves(moves, movies)
    assert [tuple(r) for r in fine.collect()] == [(3, 1)] and [tuple(r) for r in refused.collect()] == [(2, 1)]


def test_people_and_titles(spark):
    cases = [("Joel Cohen, Ethan Coen", "Joel Coen", True), ("Phil Lord, Christopher Miller", "Phil Lord & Chris Miller", True), ("Agnès Varda", "Jacques Demy", False), ("", "x", True), ("Directed by A B; C D", "C D", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", E.people_match(E.person_names(F.col("a")), E.person_names(F.col("b"))).alias("got")).collect())
    movie = "struct<id:long,keys:array<string>,tmdb_id:int,director:string,year:int,programme:boolean>"
    m = lambda i, t, tmdb=None, who=None, year=None, prog=False: (i, [t], tmdb, who, year, prog)
    pairs = [
        (m(1, "the lego movie", 5, "Phil Lord, Christopher Miller", 2026), m(2, "the lego movie", None, "Phil Lord & Chris Miller", 2025), True),
        (m(1, "la mort de moliere"), m(2, "stations la mort de moliere", prog=True), False),
        (m(1, "creeley", None, "A B"), m(2, "two creeley mcclure", None, "A B"), False),
        (m(1, "funny games", 10234), m(2, "funny games", 8461), False),
        (m(1, "heat", None, "Michael Mann", 1995), m(2, "heat", None, "Michael Mann", 1986), False),
        (m(1, "heat"), m(2, "heat"), False),
    ]
    df = spark.createDataFrame(pairs, f"a {movie}, b {movie}, want boolean")
    assert [r.got for r in df.select(E.likely_duplicate(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]
    variants = spark.createDataFrame([("TheMatrix2",), ("Ran",)], "t string").select(E.query_variants(F.col("t")).alias("v")).collect()
    assert variants[0].v == ["TheMatrix2", "The Matrix 2", "The Matrix2"] and variants[1].v == ["Ran"]
    rank = spark.createDataFrame([(0, 1), (0, 3), (0, 9), (5, 9), (7, 9)], "r int, n int").select(E.rank_bonus(F.col("r"), F.col("n")).alias("b"))
    assert [r.b for r in rank.collect()] == [75, 52, 40, 0, 0]


def test_jobs(spark):
    assert J.mode("2026-04-10 16:00:00") == "summary" and J.mode("2026-04-09 16:00:00") == "transition" and J.mode("2026-04-10 20:00:00", force=True) == "summary"
    assert J.runs_now("2026-04-10 16:30:00") and not J.runs_now("2026-04-10 12:00:00") and J.runs_now("2026-04-10 12:00:00", True)
    wants = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "user_id int, movie_id int, added_while_on_screen boolean")
    shows = spark.createDataFrame([(1, "s3", 3), (1, "s1", 1), (1, "s2", 2), (2, "s9", 1)], "movie_id int, showtime_id string, start int")
    users = J.reachable(spark.createDataFrame([(1, "a@b"), (2, ""), (3, "c@d")], "user_id int, email string"), spark.createDataFrame([(3, False)], "user_id int, enabled boolean"))
    none = spark.createDataFrame([], "user_id int, movie_id int")
    due = J.reminder_transition(wants, shows, none, users)
    assert [(r.user_id, r.movie_id, [x.showtime_id for x in r.showtimes]) for r in due.collect()] == [(1, 1, ["s1", "s2"])]
    ledger = J.ledger_rows(due)
    assert [tuple(r) for r in ledger.collect()] == [(1, 1, "s1")]
    assert J.reminder_transition(wants, shows, ledger, users).count() == 0
    posts = spark.createDataFrame([(1, "u", 7, "BUY", "ACTIVE"), (2, "v", 7, "SELL", "ACTIVE"), (3, "u", 7, "SELL", "ACTIVE"), (4, "w", 7, "SELL", "CLOSED")], "post_id int, user_id string, showtime_id int, type string, status string")
    told = spark.createDataFrame([], "trigger_id int, recipient_id int")
    first = J.matches(posts, posts.filter("post_id = 1"), told)
    assert [tuple(r) for r in first.collect()] == [(1, 2, 7)]
    assert J.matches(posts, posts.filter("post_id = 1"), first).count() == 0


def test_streams(spark, tmp_path):
    source, path = tmp_path / "in", f"file://{tmp_path}/out"
    parts = [[("a", 1, "x"), ("b", 2, "x")], [("a", 3, "y"), ("a", 4, "z"), ("c", 5, "y")]]
    schema = "k string, position int, v string"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        sinks.upsert_stream(stream, path, f"{tmp_path}/c1", ["k"], ["position"]).awaitTermination()
        sinks.ledger_stream(stream, f"{path}2", f"{tmp_path}/c2", ["k"], ["position"]).awaitTermination()
    assert sorted(map(tuple, sinks.latest(spark, path).collect())) == [("a", 3, "y"), ("b", 2, "x"), ("c", 5, "y")]
    assert sorted(map(tuple, sinks.latest(spark, f"{path}2").collect())) == [("a", 1, "x"), ("b", 2, "x"), ("c", 5, "y")]
