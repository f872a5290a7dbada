"""Entity resolution: blocking, scores as column arithmetic, staged matching, merge plans, survivorship.

Columns with keys (``title_key``, ``original_key``, ``director_key``) come from
``with_keys``, so Python runs once for each distinct title and joins are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions.titles import canonical_title
from lumenreel.operators.predicates import first_present, present
from lumenreel.operators.relational import union_all
from lumenreel.session import checkpoint

EXACT_MIN, LOOSE_MIN = 90, 60


def with_keys(df: DataFrame, titles: tuple[str, ...] = ("title", "original_title"), director: str = "director") -> DataFrame:
    """Adds ``<title>_key`` for each title and ``director_key`` (empty where missing)."""
    for c in titles:
        found = df.select(c).distinct().withColumn(f"{c}_key", T.name_key(canonical_title(F.coalesce(c, F.lit("")))))
        df = df.join(found, df[c].eqNullSafe(found[c]), "left").drop(found[c])
    return df.withColumn("director_key", T.director_key(F.col(director)) if director in df.columns else F.lit(""))


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def directors_agree(a: Column, b: Column) -> Column:
    """Keys equal or one within the other; a missing one agrees."""
    return (a == "") | (b == "") | _either_contains(a, b)


def years_agree(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def match_score(keys: Column, director: Column, year: Column, title_key: Column, original_key: Column, movie_director: Column, movie_year: Column, tmdb: Column, poster: Column) -> Column:
    """How well a probe (array of title keys, director key, year) fits a movie."""
    within = F.exists(keys, lambda k: (k != "") & (_either_contains(title_key, k) | ((original_key != "") & _either_contains(original_key, k))))
    title = F.when(F.array_contains(keys, title_key), 100).when((original_key != "") & F.array_contains(keys, original_key), 95).when(within, 35).otherwise(0)
    both = (director != "") & (movie_director != "")
    who = F.when(both & directors_agree(director, movie_director), 40).when(both, -20).otherwise(0)
    far = F.abs(year - movie_year)
    when = F.when(far == 0, 25).when(far == 1, 10).when(far > 1, -20).otherwise(0)
    return title + who + when + F.when(present(tmdb).isNotNull(), 5).otherwise(0) + F.when(present(poster).isNotNull(), 5).otherwise(0)


def containing_pairs(short: DataFrame, long: DataFrame, short_key: str, long_key: str, keep: tuple[str, ...], most: int = 4) -> DataFrame:
    """Pairs where ``short_key`` is within ``long_key``: texts meet on the rarest stretch of the short one, then are compared.

    Stretches have ``most`` characters, or as many as a shorter text has; common ones are never a key if a text has others.
    """
    within = lambda c, n: f"if(length({c}) >= {n}, transform(sequence(1, length({c}) - {n} + 1), i__ -> substr({c}, i__, {n})), array())"
    b = long.filter(F.length(long_key) > 0).withColumn("gram__", F.explode(F.array_distinct(F.expr(f"flatten(transform(sequence(1, {most}), n__ -> {within(long_key, 'n__')}))"))))
    often = b.groupBy("gram__").agg(F.count(F.lit(1)).alias("often__"))
    keys = short.select(F.col(short_key).alias("key__")).filter("key__ <> ''").distinct()
    grams = keys.withColumn("gram__", F.explode(F.array_distinct(F.expr(within("key__", f"least(length(key__), {most})")))))
    rarest = grams.join(often, "gram__", "left").groupBy("key__").agg(F.min_by("gram__", F.struct(F.coalesce("often__", F.lit(0)), F.col("gram__"))).alias("gram__"))
    a = short.join(rarest, F.col(short_key) == F.col("key__")).drop("key__")
    return a.join(b, "gram__").filter(F.contains(long_key, F.col(short_key))).select(*keep)


def candidates(probes: DataFrame, movies: DataFrame, loose: bool) -> DataFrame:
    """(probe_id, movie_id): equal title keys; ``loose`` adds titles within titles, of four letters or more, several words, or other scripts."""
    keys = probes.select("probe_id", F.explode("keys").alias("key"))
    names = union_all(movies.select("movie_id", F.col("title_key").alias("name")), movies.select("movie_id", F.col("original_title_key").alias("name"))).filter("name <> ''")
    found = keys.join(names.withColumnRenamed("name", "key"), "key").select("probe_id", "movie_id")
    if loose:
        eligible = keys.filter((F.length("key") >= 4) | F.contains("key", F.lit(" ")) | F.rlike("key", F.lit(r"[^\x00-\x7F]")))
        found = found.union(containing_pairs(eligible, names, "key", "name", ("probe_id", "movie_id"))).union(containing_pairs(names, eligible, "name", "key", ("probe_id", "movie_id")))
    return found.distinct()


def best_matches(probes: DataFrame, movies: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(probe_id, movie_id, score): of movies that pass the gates the one of the highest score, the lowest id on ties."""
    p = probes.select("probe_id", "keys", F.col("director_key").alias("pd"), F.col("year").alias("py"))
    m = movies.select("movie_id", "title_key", "original_title_key", F.col("director_key").alias("md"), F.col("year").alias("my"), "tmdb_id", "poster")
    rows = pairs.join(p, "probe_id").join(m, "movie_id").filter(directors_agree(F.col("pd"), F.col("md")) & years_agree(F.col("py"), F.col("my")))
    score = match_score(F.col("keys"), F.col("pd"), F.col("py"), F.col("title_key"), F.col("original_title_key"), F.col("md"), F.col("my"), F.col("tmdb_id"), F.col("poster"))
    ranked = rows.withColumn("score", score).filter(F.col("score") >= least)
    return ranked.groupBy("probe_id").agg(F.max(F.struct("score", (-F.col("movie_id")).alias("m"))).alias("b")).select("probe_id", (-F.col("b.m")).alias("movie_id"), "b.score")


def match(probes: DataFrame, movies: DataFrame) -> DataFrame:
    """(probe_id, movie_id, via): a cascade in which each stage sees what the ones before it left.

    Probes: probe_id, keys, director_key, year, tmdb_id, imdb, links. Movies:
    movie_id, the keys, year, tmdb_id, imdb, links (canonical addresses), poster.
    """
    first = lambda pairs, via: pairs.groupBy("probe_id").agg(F.min("movie_id").alias("movie_id")).withColumn("via", F.lit(via))
    stages, left = [], probes
    for key in ("tmdb_id", "imdb"):
        hit = first(left.filter(F.col(key).isNotNull()).select("probe_id", key).join(movies.select("movie_id", key), key), key)
        stages.append(hit)
        left = left.join(hit, "probe_id", "left_anti")
    # A stored address may go on behind the probe's; case does not count. It is offered under those of its beginnings that are as long as an asked one.
    left = checkpoint(left)
    asked = left.select("probe_id", F.explode("links").alias("link")).filter("link <> ''").withColumn("link", F.lower("link"))
    sizes = asked.agg(F.collect_set(F.length("link")).alias("sizes")).scalar()
    whole = movies.select("movie_id", F.explode("links").alias("whole")).withColumns({"whole": F.lower("whole"), "sizes": sizes})
    begins = F.transform(F.filter("sizes", lambda n: n <= F.length("whole")), lambda n: F.substring(F.col("whole"), F.lit(1), n))
    stored = whole.select("movie_id", F.explode(begins).alias("link"))
    link = first(asked.join(stored, "link"), "link")
    link = checkpoint(link)
    stages.append(link)
    left = checkpoint(left.join(link, "probe_id", "left_anti"))
    for loose, least, via in ((False, EXACT_MIN, "title"), (True, LOOSE_MIN, "loose_title")):
        hit = checkpoint(best_matches(left, movies, candidates(left, movies, loose), least).select("probe_id", "movie_id").withColumn("via", F.lit(via)))
        stages.append(hit)
        left = left.join(hit, "probe_id", "left_anti")
    return union_all(*stages)


def search_score(title: Column, candidate: Column, original: Column, director: Column, candidate_director: Column, year: Column, candidate_year: Column, runtime: Column, candidate_runtime: Column) -> Column:
    """Score of an external search result; texts are name keys."""
    near = (title != "") & (((candidate != "") & _either_contains(candidate, title)) | ((original != "") & _either_contains(original, title)))
    base = F.when((title != "") & (title == candidate), 90).when((title != "") & (title == original), 80).when(near, 35).otherwise(0)
    both = (director != "") & (candidate_director != "")
    who = F.when(both & _either_contains(director, candidate_director), 60).when(both, -20).otherwise(0)
    far, off = F.abs(year - candidate_year), F.abs(runtime - candidate_runtime)
    when = F.when(far == 0, 55).when(far == 1, 20).when(far == 2, 8).when(far > 2, -20).otherwise(0)
    length = F.when(off <= 2, 12).when(off <= 5, 6).when(off >= 20, -10).otherwise(0)
    return base + who + when + length


def rank_bonus(rank: Column, results: Column) -> Column:
    """Bonus of a result's place (from 0) and of being among few."""
    few = F.when((rank == 0) & (results == 1), 35).when((rank == 0) & (results <= 3), 12).otherwise(0)
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, (40, 26, 16, 10, 5, 0))), rank + 1), F.lit(0)) + few


def confident(score: Column, has_metadata: Column, exact_title: Column, exact_original: Column, sole_first: Column) -> Column:
    return (score >= F.when(has_metadata, 95).otherwise(80)) | (exact_title & (score >= 88)) | (exact_original & (score >= 75)) | (sole_first & ~has_metadata & (score >= 70))


def query_variants(title: Column, most: int = 8) -> Column:
    """Spellings of a title to search for: as it is, split where case or digits change, split behind an article."""
    plain = T.collapse(title)
    split = plain
    for pattern, to in ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (r"([A-Za-z])(\d)", "$1 $2"), (r"(\d)([A-Za-z])", "$1 $2"), (r"[:._-]+", " ")):
        split = F.regexp_replace(split, pattern, to)
    split = T.collapse(split)
    # Articles that a title may be glued to.
    articles = ["the", "le", "la", "les", "un", "une", "el", "los", "las"]
    glued = lambda c: [F.when(F.rlike(c, F.lit(rf"(?i)^{a}\p{{L}}[\p{{L}}\p{{N}}'.-]{{2,}}$")), F.concat(F.substring(c, 1, len(a)), F.lit(" "), F.substring(c, len(a) + 1, 1 << 20))) for a in articles]
    return F.slice(F.array_distinct(F.filter(F.array(plain, split, *glued(plain), *glued(split)), lambda x: x.isNotNull() & (x != ""))), 1, most)


def person_names(c: Column) -> Column:
    """Names of a list of people as arrays of (first, last) keys."""
    names = F.split(F.regexp_replace(T.collapse(c), r"(?i)^directed by\s*", ""), r"(?i)\s*(?:,|&| and |/|;|\+)\s*")
    keys = F.filter(F.transform(names, lambda x: F.trim(F.regexp_replace(F.replace(F.lower(x), F.lit("'"), F.lit("")), r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")
    return F.transform(keys, lambda x: F.named_struct(F.lit("first"), F.element_at(F.split(x, " "), 1), F.lit("last"), F.element_at(F.split(x, " "), -1)))


def names_match(a: Column, b: Column) -> Column:
    """Last names equal, within one another or one edit apart; first names by four letters or as a prefix."""
    least = F.least(F.length(a.first), F.length(b.first), F.lit(4))
    last = _either_contains(a.last, b.last) | (F.levenshtein(a.last, b.last, 1) >= 0)
    first = F.startswith(a.first, b.first) | F.startswith(b.first, a.first) | ((least >= 3) & (F.substr(a.first, F.lit(1), least) == F.substr(b.first, F.lit(1), least)))
    return last & first


def people_match(a: Column, b: Column) -> Column:
    """Every name of the smaller list matches one of the larger; a missing list matches."""
    fit = lambda small, large: F.forall(small, lambda x: F.exists(large, lambda y: names_match(x, y)))
    return F.when(F.size(a) <= F.size(b), fit(a, b)).otherwise(fit(b, a)) | (F.size(a) == 0) | (F.size(b) == 0)


def people_signature(c: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(person_names(c), lambda x: F.concat(x.last, F.lit(":"), F.substring(x.first, 1, 4)))), "|")


# Signs of a programme of several films anywhere in a title; at its end; words of events; escapes.
PROGRAMME = [r"\bafter dark\b", r"\bdouble (?:bill|feature)\b", r"\s+\+\s+"]
PROGRAMME_NUMBER = r"\b(?:pgm|program)\s+\d+\s*$"
PRESENTED = r"\bpresents:?\b"
EVENT_TEXT = r"\b(q(?:\s*&\s*|\s+and\s+)a|q&a|qa|in person|discussion|panel|conversation|filmmaker|director|guest|live score)\b"
ESCAPED = r"\\u[0-9a-fA-F]{4}"


def _has(text: Column, *patterns: str) -> Column:
    return F.rlike(text, F.lit("(?i)" + "|".join(patterns)))


def programme(title: Column) -> Column:
    return _has(T.clean(title), PROGRAMME_NUMBER, *PROGRAMME)


def suspicious(title: Column, canonical: Column) -> Column:
    """A title that is not its canonical form, a programme, or names a presenter or an event."""
    text = T.clean(title)
    return (text != "") & ((text != canonical) | programme(title) | _has(text, ESCAPED, PRESENTED, EVENT_TEXT))


def titles_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(some keys equal, some key of two words or more stands as whole words in one of the other side)."""
    inside = lambda x, y: (F.length(x) >= 4) & (F.length(y) >= 4) & F.contains(x, F.lit(" ")) & F.contains(F.concat(F.lit(" "), y, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
    plain = [F.filter(x, lambda k: k != "") for x in (a, b)]
    within = F.exists(plain[0], lambda x: F.exists(plain[1], lambda y: inside(x, y) | inside(y, x)))
    return F.arrays_overlap(*plain), within


def likely_duplicate(a: Column, b: Column) -> Column:
    """Two movies (structs of id, keys, tmdb_id, director, year, programme) are one."""
    equal, within = titles_overlap(a.keys, b.keys)
    people = (F.coalesce(a.director, F.lit("")) != "") | (F.coalesce(b.director, F.lit("")) != "")
    known = a.tmdb_id.isNotNull() | b.tmdb_id.isNotNull()
    same = F.coalesce(a.tmdb_id == b.tmdb_id, F.lit(True))
    return (a.id != b.id) & same & (equal | (within & ~a.programme & ~b.programme)) & (~people | people_match(person_names(a.director), person_names(b.director))) & (people | known) & (known | years_agree(a.year, b.year))


def target_score(desired: Column, tmdb: Column, clean_title: Column, original: Column, imdb: Column, poster: Column, showtimes: Column, suspect: Column) -> Column:
    """Fitness of a row to be the one the others merge into."""
    has = lambda c, n: F.when(present(c).isNotNull(), n).otherwise(0)
    ids = F.when(F.coalesce(tmdb == desired, F.lit(False)), 5000).when(tmdb.isNotNull(), 2000).otherwise(0)
    return ids + F.when(clean_title, 120).otherwise(0) + has(original, 70) + has(imdb, 40) + has(poster, 20) + F.least(F.coalesce(showtimes, F.lit(0)), F.lit(25)) + F.when(suspect, 0).otherwise(50)


def merge_plan(rows: DataFrame, group: str, key: str, tmdb: str, score: str, directors: str) -> DataFrame:
    """group, kind (merge or conflict), target, sources in merge order; groups with several external ids are conflicts and merge nothing."""
    by = Window.partitionBy(group).orderBy(F.desc(score), key)
    ranked = rows.withColumn("place__", F.row_number().over(by))
    order = F.struct(F.col(tmdb).isNotNull().alias("t"), F.col(directors).alias("d"), F.col(key).alias("k"))
    found = ranked.groupBy(group).agg(F.size(F.collect_set(tmdb)).alias("ids"), F.min(F.when(F.col("place__") == 1, F.col(key))).alias("target"), F.array_sort(F.collect_list(F.when(F.col("place__") > 1, order))).alias("sources"), F.count(F.lit(1)).alias("n_rows"))
    clash = F.col("ids") > 1
    return found.select(group, F.when(clash, "conflict").otherwise("merge").alias("kind"), F.when(~clash, F.col("target")).alias("target"), F.when(~clash, F.transform("sources", lambda x: x.k)).alias("sources"), "n_rows")


def survivor(existing: Column, external: Column | None = None, fallback: Column | None = None) -> Column:
    """First that is neither missing, empty nor zero."""
    return first_present(*[c for c in (existing, external, fallback) if c is not None])


def surviving_poster(existing: Column, external: Column, fallback: Column) -> Column:
    good = lambda c: F.when(~T.bad_poster(c), c)
    return F.coalesce(present(external), good(existing), good(fallback))


def surviving_date(existing: Column, tmdb_id: Column, external: Column, fallback: Column) -> Column:
    """The external date wins over a missing one, a local one, and a first of January that only stands for a year."""
    year_only = (F.date_format(existing, "MM-dd HH:mm:ss") == "01-01 00:00:00")
    return F.when(external.isNotNull() & (tmdb_id.isNull() | year_only), external).otherwise(F.coalesce(existing, external, fallback))


def title_noise(title: Column) -> Column:
    """Points for presenter, event, bar, format and loose end of a title."""
    text = T.collapse(title)
    # Patterns and their points.
    rules = [
        (r"^.+?\s+presents:?\s+.+", 6),
        (r"\s+\+\s*(?:q(?:\s*&\s*|\s+and\s+)a|qa|intro(?:duction)?|seminar|discussion|panel|conversation|in person)\b", 5),
        (r"\s+\|\s+.+", 4),
        (r"\s*[-–—]\s*(?:4K\s*DCP|DCP|35\s*MM|16\s*MM|70\s*MM|IMAX|DIGITAL|BLU[\s-]?RAY|SUPER[\s-]?8(?:MM)?)\b", 4),
        (r"[-–—:|]\s*$", 3),
    ]
    out = F.lit(0)
    for pattern, points in rules:
        out = out + F.when(F.rlike(text, F.lit(f"(?i){pattern}")), points).otherwise(0)
    return out


def fingerprint(theater_slug: Column, canonical: Column, start: Column, kind: Column) -> Column:
    """Key of a showtime: SHA-256 over slug, canonical title, UTC start and format, lower case."""
    iso = F.concat(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return F.sha2(F.concat_ws("|", F.lower(theater_slug), F.lower(canonical), iso, F.lower(kind)), 256)


def one_edit_pairs(names: DataFrame, name: str) -> DataFrame:
    """(a, b), a < b, of distinct names at most one edit apart: they meet on a variant with at most one letter left out."""
    text = F.col(name)
    variants = F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))))
    keyed = names.select(name).distinct().select(text.alias("x"), F.explode(variants).alias("variant"))
    other = keyed.select(F.col("x").alias("y"), "variant")
    return keyed.join(other, "variant").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().filter(F.levenshtein("a", "b", 1) >= 0)
