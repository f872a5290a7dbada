"""Readers on small landed files and records."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lumenreel.plans import ingest
from lumenreel.sources import imports, listings


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def test_nested_json(spark):
    data = [{"title": "Ran", "runtime": 162, "showdates": [{"date": "2026-04-18", "showtypes": [{"type": "35mm", "showtimes": [{"id": "1", "date_time": "2026-04-18T19:30:00", "url": "u"}, {"id": "2", "date_time": None, "url": None}]}]}]}, {"title": None, "showdates": []}]
    rows = listings.nested_json(bodies(spark, json.dumps(data), "not json")).orderBy("source_showtime_id").collect()
    assert [(r.movie_title, r.start_raw, r.raw_format, r.runtime) for r in rows] == [("Ran", "2026-04-18T19:30:00", "35mm", 162), ("Ran", "2026-04-18", "35mm", 162)]


def test_film_json(spark):
    film = {"title": "Heat", "slug": "heat", "showtimes": [{"id": "1", "date": "2026-04-11", "time": "6:30 PM", "venue": "A", "ticketsUrl": "t"}, {"id": "2", "date": "2026-04-11", "time": "9:00 PM", "venue": "B", "freeEvent": True}, {"id": "3", "date": "d", "time": "t", "venue": "Partner"}]}
    details = spark.createDataFrame([("heat", 1995, 170, "Michael Mann", "o", "p")], "slug string, year int, runtime int, director string, overview string, poster_url string")
    rows = listings.film_json(bodies(spark, json.dumps(film)), ["A", "B"], details).orderBy("start_raw").collect()
    assert [(r.start_raw, r.ticket_url, r.year) for r in rows] == [("2026-04-11 6:30 PM", "t", 1995), ("2026-04-11 9:00 PM", "FREE", 1995)]
    assert listings.film_json(bodies(spark, json.dumps(film)), ["A"]).count() == 1


ICS = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:7\r\nDTSTART;TZID=America/New_York:20260418T193000\r\nSUMMARY:Ran\\, restored &amp; lo\r\n ng\r\nCATEGORIES:Film,Screening\r\nDESCRIPTION:One\\nTwo\r\nURL;VALUE=URI:https://a.b/c\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:8\r\nDTSTART:20260418T193000Z\r\nSUMMARY:Tour\r\nCATEGORIES:Tours\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"


def test_calendar(spark):
    rows = listings.calendar(bodies(spark, ICS)).collect()
    assert [(r.movie_title, r.start, r.source_url, r.overview, r.source_showtime_id) for r in rows] == [("Ran, restored & long", datetime.datetime(2026, 4, 18, 23, 30), "https://a.b/c", "One Two", "7")]
    assert listings.calendar(bodies(spark, ICS), category=None).count() == 2


def test_pages(spark):
    ld = '<script type="application/ld+json">[{"@type":"ScreeningEvent","name":"Ran &amp; more","startDate":"2026-04-18T19:30:00-04:00","url":"u"},{"@type":"Person","name":"x","startDate":"y"}]</script>'
    rows = listings.json_ld(bodies(spark, ld, "<p>none</p>")).collect()
    assert [(r.movie_title, r.start_raw, r.ticket_url) for r in rows] == [("Ran & more", "2026-04-18T19:30:00-04:00", "u")]
    page = '<li class="show"><h3><a href="/f/1">Ran</a></h3><p>1985 / 162 min / 35mm</p><time>April 18 7:30 PM</time></li><li class="show"><h3>No time</h3></li>'
    rows = listings.markup(bodies(spark, page), r'(?s)<li class="show">(.*?)</li>', {"movie_title": r"(?s)<h3>(.*?)</h3>", "start_raw": "<time>(.*?)</time>", "meta": "<p>(.*?)</p>", "source_url": 'href="([^"]+)"'}).collect()
    assert [(r.movie_title, r.start_raw, r.year, r.runtime, r.raw_format, r.source_url) for r in rows] == [("Ran", "April 18 7:30 PM", 1985, 162, "35mm", "/f/1")]
    script = '<script>self.__next_f.push([1,"{\\"films\\":[{\\"title\\":\\"Ran\\",\\"id\\":3}]}"])</script>'
    assert [tuple(r) for r in listings.script_payloads(bodies(spark, script), "films", "struct<title:string,id:int>").collect()] == [("Ran", 3)]
    with pytest.raises(KeyError):
        listings.reader("gopher")


def test_imports(spark, tmp_path):
    douban = tmp_path / "d.csv"
    douban.write_text("﻿封面\t标题\t个人评分\t打分日期\t我的短评\t上映日期\t制片国家\t条目链接\np\t秘密 / Secret / Himitsu\t4.5\t1999/09/25\tgood film\t1999-09-25(日本)\t日本\thttps://m.d/1/\n\t\t3.7\n", encoding="utf-8")
    rows = imports.normalized(imports.read_csv(spark, str(douban))).collect()
    assert [(r.provider, r.title, r.candidates, r.year, r.rating, r.watched_at, r.review_words, r.link) for r in rows] == [("douban", "秘密", ["秘密", "Secret", "Himitsu"], 1999, 4.5, datetime.datetime(1999, 9, 25, 12), 2, "https://m.d/1")]
    other = tmp_path / "l.csv"
    other.write_text('LetterboxdURI,tmdbID,imdbID,Title,Year,Directors,Rating,WatchedDate,Review\nu,1,tt0000001,"Good, Bad",1966,S. Leone,3.7,2001-01-02,"two\nlines"\n,,,,,,,,\n')
    r = imports.normalized(imports.read_csv(spark, str(other))).collect()
    assert [(x.title, x.year, x.rating, x.tmdb_id, x.imdb, x.review) for x in r] == [("Good, Bad", 1966, None, 1, "tt0000001", "two lines")]
    assert imports.provider(["a", "b"]) is None
    with pytest.raises(ValueError):
        imports.normalized(spark.createDataFrame([("x",)], "a string"))


def test_ingest(spark):
    now = "2026-04-05 16:00:00"
    raw = spark.createDataFrame([(0, "Ran [35mm]", "April 18 7:30 PM", "35mm", "", "Akira Kurosawa", 1985), (1, "RAN", "April 18 7:30 PM", "35mm", "", "Akira Kurosawa", 1986), (2, "Ran", "April 18 7:30 PM", "35 mm print 35mm", "", "A. Kurosawa", 1985), (3, "Spring Shorts", "someday", None, "", None, None), (4, "Heat", "April 19 8:00 PM", None, "", None, 1995)], "position int, movie_title string, start_raw string, raw_format string, overview string, director string, year int")
    rows = ingest.listing(ingest.parsed(raw, now))
    assert sorted(r.position for r in rows.collect()) == [0, 1, 4]
    made = ingest.new_movies(rows.withColumn("title_key", F.lower("title")), 10).collect()
    assert sorted((r.movie_id, r.title, sorted(r.positions)) for r in made) == [(11, "Ran", [0, 1]), (12, "Heat", [4])]
    stored = spark.createDataFrame([("old", 1, 5, datetime.datetime(2026, 4, 20, 1), "35mm", "SCHEDULED"), ("far", 1, 6, datetime.datetime(2026, 4, 20, 1), "35mm", "SCHEDULED"), (None, 1, 5, datetime.datetime(2026, 4, 21, 1), "35mm", "SCHEDULED")], "fingerprint string, movie_id long, theater_id long, start timestamp_ntz, format string, status string")
    after = ingest.tombstoned(stored, rows.withColumn("movie_id", F.lit(11).cast("long")), 5, "quad", now).collect()
    assert {r.fingerprint: r.status for r in after if r.fingerprint in ("old", "far", None)} == {"old": "CANCELED", "far": "SCHEDULED", None: "SCHEDULED"}
    assert len(after) == 5
