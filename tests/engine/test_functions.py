"""Text, number and time functions on the cases that define them."""

import datetime

from pyspark.sql import functions as F

from lumenreel.functions import numbers as N
from lumenreel.functions import text as T
from lumenreel.functions import times as D
from lumenreel.operators import predicates as P

NOW = "2026-04-05 16:00:00"


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text(spark):
    assert apply(spark, T.clean, ["Q\\u0026A  with X ", None, "﻿a\n b", "\\u00e9\\u00E8!"]) == ["Q&A with X", "", "a b", "éè!"]
    assert apply(spark, T.decode_entities, ["&amp;quot; &#8217;&hellip;&nbsp;x", None]) == ['" ’… x', None]
    assert apply(spark, T.loose, ["Amélie & Bob's  café!"]) == ["amelie and bobs cafe"]
    assert len(set(apply(spark, T.name_key, ["Sirât", "Sirāt", "SIRAT"]))) == 1
    assert apply(spark, T.name_key, ["Bob's", "Bob’s", "七人の侍 (1954)"]) == ["bobs", "bob s", "七人の侍 1954"]
    assert apply(spark, T.director_key, ["Directed by Joel Coen, Ethan Coën"]) == ["joel coen, ethan coen"]
    assert apply(spark, T.slug, ["  Sci-Fi & Fantasy!", "Été"]) == ["sci-fi-fantasy", "ete"]
    assert apply(spark, T.strip_bullets, ["· • Ran"]) == ["Ran"]
    assert apply(spark, T.imdb_id, ["https://www.imdb.com/title/TT0000001/", "x", None]) == ["tt0000001", None, None]
    assert apply(spark, T.canonical_url, ["https://a.b/c/?q=1#x", "https://a.b/c//", ""]) == ["https://a.b/c/?q=1", "https://a.b/c", None]
    assert apply(spark, lambda c: T.canonical_url(c, True), ["https://a.b/c/?q=1#x"]) == ["https://a.b/c"]
    assert apply(spark, lambda c: T.absolute_url(c, "https://a.b/c/d"), ["/x", "y", "//z.w/q", "mailto:a", " "]) == ["https://a.b/x", "https://a.b/c/y", "https://z.w/q", "mailto:a", None]
    assert apply(spark, T.html_text, ["<p>a<br>b &amp; c</p><script>x<y</script><!-- n -->d"]) == ["a b & c d"]
    assert apply(spark, T.words, ["a  b c", "", None]) == [3, 0, 0]
    assert apply(spark, T.mostly_han, ["七人 ab", "七 abc", "123"]) == [True, False, False]
    assert apply(spark, T.bad_poster, ["https://x/BAM_logo.gif", "https://x/p.jpg", None]) == [True, False, True]
    assert apply(spark, T.program_title, ["Spring Shorts", "Ran"]) == [True, False]
    assert apply(spark, lambda c: T.program_content(c, F.lit("")), ["A Tribute to X", "Ran"]) == [True, False]
    assert apply(spark, lambda c: T.program_content(F.lit("Ran"), c), ["Part of the 5th Film Festival.", "Special thanks to Y", "A film."]) == [True, True, False]
    assert apply(spark, T.mask_mail, ["Anna@b.c"]) == ["a***@b.c"]
    assert apply(spark, T.unique_texts, [["A", "a ", None, "", "b"]], "array<string>") == [["A", "b"]]
    assert apply(spark, T.escape_html, ["<a href='x'>&"]) == ["&lt;a href=&#39;x&#39;&gt;&amp;"]
    assert apply(spark, T.is_free, [" free ", "x", None]) == [True, False, False]


def test_numbers(spark):
    assert apply(spark, N.year, ["USA, 1957", "12345", None]) == [1957, None, None]
    assert apply(spark, N.runtime, ["96 min.", "101.5 minutes", "88m", "5 mins", "x"]) == [96, 102, 88, 5, None]
    assert apply(spark, N.find_format, ["4K DCP", "New 35 mm print", "blu-ray", "x"]) == ["4K DCP", "35mm", "Blu-ray", None]
    assert apply(spark, N.normal_format, ["4K DCP", "70mm IMAX", "super-8", "", None, "Dolby 3D"]) == ["4K DCP", "70mm", "Super 8", "Standard", "Standard", "3D"]
    assert apply(spark, N.rating, ["4.5", "3.7", "5.5", "", "0"]) == [4.5, None, None, None, 0.0]
    assert [tuple(x) for x in apply(spark, N.meta, ["1957 / 96 min / 35mm", "1960 / 90 min / silent"])] == [(1957, 96, "35mm", None), (1960, 90, "silent", "silent")]
    assert [tuple(x) for x in apply(spark, lambda c: N.meta(c, ","), ["1957, Sweden, 96 min, DCP"])] == [(1957, 96, "DCP", "Sweden")]
    assert apply(spark, N.price_label, [1250, None], "int") == ["$12.50", None]


def test_times(spark):
    at = lambda *x: datetime.datetime(*x)
    got = apply(spark, lambda c: D.parse_start(c, NOW), [
        "Saturday, April 18, 2026 3:50 PM", "Sat April 18 2026 3:50 pm", "April 18 7:30", "April 18", "4/18 10:30am", "2026-04-18 19:30", "January 9 8:00 PM", "2026-04-18T19:30:00-04:00", "2026-04-18T19:30:00", "not a time", None, "Apr 18, 2026", "April 18 7:30 PM 2026",
    ])
    assert got == [at(2026, 4, 18, 19, 50), at(2026, 4, 18, 19, 50), at(2026, 4, 18, 23, 30), at(2026, 4, 18, 16, 0), at(2026, 4, 19, 2, 30), at(2026, 4, 18, 23, 30), at(2027, 1, 10, 1, 0), at(2026, 4, 18, 23, 30), at(2026, 4, 18, 23, 30), None, None, at(2026, 4, 18, 16, 0), at(2026, 4, 18, 23, 30)]
    df = spark.createDataFrame([(1, 2), (12, 30), (2, 29)], "m int, d int")
    assert [r.y for r in df.select(D.nearest_year(F.col("m"), F.col("d"), "2026-01-05 16:00:00").alias("y")).collect()] == [2026, 2025, None]
    assert apply(spark, D.noon_of, ["1999/09/25", "2001-1-2", "x"]) == [at(1999, 9, 25, 12), at(2001, 1, 2, 12), None]
    one = spark.createDataFrame([("20260418T193000", "America/New_York"), ("20260418T193000Z", None), ("20260418", None)], "v string, z string")
    assert [r.o for r in one.select(D.ics_time(F.col("v"), F.col("z")).alias("o")).collect()] == [at(2026, 4, 18, 23, 30), at(2026, 4, 18, 19, 30), at(2026, 4, 18, 4, 0)]
    utc = spark.createDataFrame([("2026-04-18 23:50:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    r = utc.select(D.local_day(F.col("t")).alias("d"), D.local_clock(F.col("t")).alias("c"), D.mail_label(F.col("t")).alias("m"), D.iso_utc(F.col("t")).alias("i")).first()
    assert tuple(r) == ("2026-04-18", "19:50", "Sat, Apr 18 at 7:50 PM", "2026-04-18T23:50:00.000Z")


def test_predicates(spark):
    df = spark.createDataFrame([(403, {}, ""), (200, {"cf-mitigated": "challenge"}, ""), (200, {}, "<title>Just a moment...</title>"), (200, {}, "<h1>Now playing</h1>"), (200, None, None)], "s int, h map<string,string>, b string")
    assert [r.o for r in df.select(P.blocked_response(F.col("s"), F.col("h"), F.col("b")).alias("o")).collect()] == [True, True, True, False, False]
    days = spark.createDataFrame([("2026-04-05 03:59:59",), ("2026-04-05 04:00:00",), ("2026-04-06 03:59:59",), ("2026-04-05 15:59:59",), ("2026-04-05 16:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    assert [r.o for r in days.select(P.in_day(F.col("t"), "2026-04-05", NOW).alias("o")).collect()] == [False, False, True, False, True]
    assert [r.o for r in days.select(P.in_day(F.col("t"), "2026-04-05", "2026-04-01").alias("o")).collect()] == [False, True, True, True, True]
