import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import blending as B
from lumenreel.sources import dimensions as D
from lumenreel.sources import runs
from lumenreel.streaming import deliveries


def test_blend_against_a_loop(spark):
    rng = random.Random(4)
    texts = [None, "", "Heat", " Heat  ", "The Heat", "a longer text that says more than the others do"]
    event = lambda: (rng.choice(["d1", "d2"]), rng.choice(["7pm", " 7pm", None]), rng.randrange(5))
    rows = [(rng.choice(["x", "y", None]), r % 3, r, rng.choice(texts), rng.choice([None, 0, 90, 100]), rng.choice(texts), rng.choice(texts), rng.choice([None, True, False]), [rng.choice("abcd") for _ in range(rng.randrange(4))], [event() for _ in range(rng.randrange(3))]) for r in range(40)]
    schema = "k string, rank int, position int, title string, runtime int, overview string, note string, third boolean, names array<string>, events array<struct<d:string,t:string,n:int>>"
    how = B.Blend(first=["title"], last=["runtime"], longest=["note"], longer={"overview": 40}, any=["third"], union=["names"], events={"events": ["d", "t"]})
    rng.shuffle(rows)
    got = {r.k: r for r in B.blend(spark.createDataFrame(rows, schema).repartition(7), ["k"], how).collect()}
    assert set(got) == {r[0] for r in rows}
    clean = lambda t: " ".join((t or "").split())
    for k, r in got.items():
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        assert r.title == next((x[3] for x in mine if clean(x[3])), None)
        assert r.runtime == next((x[4] for x in reversed(mine) if x[4]), None)
        notes = [clean(x[6]) for x in mine if clean(x[6])]
        assert r.note == (max(notes, key=len) if notes else None)
        overviews = [clean(x[5]) for x in mine if clean(x[5])]
        longest = max(overviews, key=len, default="")
        assert r.overview == (longest if overviews and len(longest) > len(overviews[0]) + 40 else overviews[0] if overviews else None)
        assert r.third == any(x[7] for x in mine)
        assert r.names == list(dict.fromkeys(n for x in mine for n in x[8]))
        events = {}
        for x in mine:
            for e in x[9]:
                events.setdefault((e[0], clean(e[1])), e)
        assert [tuple(e) for e in r.events] == list(events.values())


def test_landed_dimensions(spark, tmp_path):
    film = {
        "id": 5, "title": " Ran ", "original_title": "乱", "release_date": "1985-06-01", "runtime": 162, "imdb_id": "TT0089881", "poster_path": "/p.jpg", "genres": [{"id": 1, "name": "Drama"}, {"id": 2, "name": "War"}],
        "credits": {"cast": [{"id": 9, "name": "B", "order": 1}, {"id": 8, "name": "A", "order": 0}], "crew": [{"id": 3, "name": "Akira Kurosawa", "gender": 2, "job": "Director"}, {"id": 3, "name": "Akira Kurosawa", "job": "Writer"}, {"id": 4, "name": "Z", "job": "Editor"}]},
    }
    lines = [json.dumps(film), "{not json", json.dumps({"id": "five", "title": "x"}), "", json.dumps({"id": 6, "title": "Plain", "runtime": 0}), json.dumps({"title": "no id"})]
    (tmp_path / "films.jsonl").write_text("\n".join(lines))
    good, bad = D.checked(D.landed(spark, str(tmp_path / "films.jsonl")), D.FILM)
    assert good.count() == 3 and sorted(r.value for r in bad.collect()) == sorted(["{not json", lines[2]])
    films = {r.tmdb_id: r for r in D.films(good).collect()}
    assert set(films) == {5, 6}
    r = films[5]
    assert (r.title, r.original_title, r.released, r.runtime, r.imdb, r.poster, r.genres, r.director, r["cast"]) == ("Ran", "乱", dt.date(1985, 6, 1), 162, "tt0089881", "https://image.tmdb.org/t/p/w500/p.jpg", "Drama, War", "Akira Kurosawa", "A, B")
    assert films[6].runtime is None and films[6].director is None
    assert list(map(tuple, D.film_credits(good).collect())) == [(5, 3, "DIRECTOR", 0)]
    made = [{"id": i, "title": t, "release_date": d, "popularity": p, "job": j} for i, t, d, p, j in [(1, "B", "1990-01-01", 2.0, "Director"), (1, "B", "1990-01-01", 3.0, "Director"), (2, "A", "1991-01-01", 3.0, "Director"), (3, "C", "", None, "Director"), (4, "W", "1999-01-01", 9.0, "Writer")]]
    people, _ = D.checked(spark.createDataFrame([(json.dumps({"id": 3, "name": "Kurosawa Akira", "gender": 2, "movie_credits": {"crew": made}}),)], "value string"), D.PERSON)
    assert [(r.place, r.tmdb_id, r.year) for r in D.filmographies(people).orderBy("place").collect()] == [(1, 2, 1991), (2, 1, 1990), (3, 3, None)]
    assert sorted(map(tuple, D.people(good, people).collect())) == [(3, "Kurosawa Akira", 2, None), (4, "Z", None, None)]


def test_run_counts_while_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "x"), ("c", "2")], "title string, raw string")
    parse = lambda df: df.withColumn("start", F.col("raw").try_cast("int"))
    plans = []

    def write(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(str(tmp_path / "out"))

    stats = runs.run(rows, parse, lambda df: df.dropDuplicates(), write, "cinema")
    assert {k: stats[k] for k in ("source", "success", "raw", "parsed", "failed", "written")} == {"source": "cinema", "success": True, "raw": 4, "parsed": 3, "failed": 1, "written": 2}
    assert plans[0].count("CollectMetrics") >= 3 and spark.read.parquet(str(tmp_path / "out")).count() == 2

    def fails(df):
        raise OSError("no room")

    assert runs.run(rows, parse, lambda df: df, fails, "cinema")["error"] == "no room"


def test_nothing_is_delivered_twice(spark, tmp_path):
    ledger, box = str(tmp_path / "ledger"), tmp_path / "box"
    box.mkdir()
    rows = spark.range(20).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(str(box)).alias("folder"), F.lit("k13").alias("breaks")).coalesce(2)
    with pytest.raises(Exception, match="line is dead"):
        deliveries.deliver(rows, ledger, "tests.engine.transport:send")
    first = set(os.listdir(box)) - {"broke"}
    assert 0 < len(first) < 20 and {r.key for r in deliveries.delivered(spark, ledger).collect()} == first
    deliveries.deliver(rows, ledger, "tests.engine.transport:send")
    deliveries.deliver(rows, ledger, "tests.engine.transport:send")
    sent = {k: (box / k).read_text() for k in os.listdir(box) if k != "broke"}
    assert len(sent) == 20 and set(sent.values()) == {"sent\n"}
    assert deliveries.delivered(spark, ledger).count() == 20
