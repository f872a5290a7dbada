"""Merging of entities: child rows of sources move to their targets, rows that then share a key fold into one.

``moves`` is (source, target) of a merge plan. No child row is lost: each moves
or folds into the row it now equals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import collapse
from lumenreel.operators.predicates import present
from lumenreel.operators.relational import keep_first


def moved(child: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Child rows with the target's key, ``moved__``, and ``from__``, the key they had."""
    to = moves.select(F.col("source").alias(key), F.col("target").alias("to__"))
    return child.join(to, key, "left").withColumns({"moved__": F.col("to__").isNotNull(), "from__": F.col(key), key: F.coalesce("to__", key)}).drop("to__")


def first_of() -> Column:
    """Rows of the target itself go before rows that moved; of these the one of the smallest source."""
    return F.struct(~F.col("moved__"), -F.col("from__"))


def showtime_score(shown: Column, ticket: Column, source: Column, source_id: Column) -> Column:
    has = lambda c: collapse(c) != ""
    return F.when(has(shown), 5).otherwise(0) + F.when(F.contains(F.coalesce(source, F.lit("")), F.lit("/events/event/")), 3).otherwise(0) + F.when(has(ticket) & ~F.contains(ticket, F.lit("/events/")), 2).otherwise(0) + F.when(has(source_id), 1).otherwise(0)


def post_score(status: Column, closed: Column, price: Column, seat: Column, quantity: Column, updated: Column) -> Column:
    """Recency counts one point for each thousand million milliseconds."""
    millis = F.unix_micros(updated.cast("timestamp")) / 1000
    return F.when(status == "ACTIVE", 10).otherwise(0) + F.when(closed.isNull(), 4).otherwise(0) + F.when(price.isNotNull(), 2).otherwise(0) + F.when(present(seat).isNotNull(), 2).otherwise(0) + F.least(quantity, F.lit(10)) + F.floor(millis / 1_000_000_000)


def fold(rows: DataFrame, keys: Sequence[str], order: Column, filled: Sequence[str] = (), largest: Sequence[str] = (), smallest: Sequence[str] = (), summed: Sequence[str] = ()) -> DataFrame:
    """Rows of a key as one: the best by ``order``; ``filled`` columns from the best row that has them, others by maximum, minimum or sum."""
    rest = [c for c in rows.columns if c not in {*keys, *filled, *largest, *smallest, *summed}]
    out = [F.max_by(c, order).alias(c) for c in rest] + [F.max_by(c, F.when(present(F.col(c)).isNotNull(), order)).alias(c) for c in filled]
    out += [F.max(c).alias(c) for c in largest] + [F.min(c).alias(c) for c in smallest] + [F.sum(c).alias(c) for c in summed]
    return rows.groupBy(*keys).agg(*out).select(*rows.columns)


def merge_showtimes(showtimes: DataFrame, moves: DataFrame, refingerprint: Column) -> tuple[DataFrame, DataFrame]:
    """(showtimes, moves of showtimes): fingerprints anew; of rows with one fingerprint the target's own stays, else the best, and is filled."""
    rows = moved(showtimes, moves, "movie_id").withColumn("fingerprint", F.when(F.col("moved__"), refingerprint).otherwise(F.col("fingerprint")))
    score = showtime_score(F.col("shown_title"), F.col("ticket_url"), F.col("source_url"), F.col("source_showtime_id"))
    keyed = rows.withColumn("fold__", F.coalesce("fingerprint", F.concat(F.lit("#"), F.col("showtime_id").cast("string"))))
    order = F.struct(~F.col("moved__"), score, -F.col("showtime_id"))
    filled = [c for c in ("shown_title", "ticket_url", "source_url", "source_showtime_id", "runtime", "end") if c in rows.columns]
    kept = fold(keyed, ["fold__"], order, filled)
    pointers = keyed.select("fold__", F.col("showtime_id").alias("source")).join(kept.select("fold__", F.col("showtime_id").alias("target")), "fold__").filter("source <> target").select("source", "target")
    return kept.select(showtimes.columns), pointers


def merge_posts(posts: DataFrame, moves: DataFrame) -> DataFrame:
    """Posts of moved showtimes; of one user and side the better stays, with the larger quantity and what it lacks."""
    rows = moved(posts, moves, "showtime_id")
    score = post_score(F.col("status"), F.col("closed_at"), F.col("price_cents"), F.col("seat_info"), F.col("quantity"), F.col("updated_at"))
    order = F.struct(score, ~F.col("moved__"), -F.col("post_id"))
    # Prices may be zero, so they fill by null only.
    priced = rows.withColumn("price__", F.struct("price_cents"))
    best = priced.groupBy("user_id", "showtime_id", "type").agg(F.max_by("price_cents", F.when(F.col("price_cents").isNotNull(), order)).alias("price__"))
    out = fold(rows, ["user_id", "showtime_id", "type"], order, filled=["seat_info", "closed_at"], largest=["quantity"])
    return out.join(best, ["user_id", "showtime_id", "type"]).withColumn("price_cents", F.col("price__")).select(posts.columns)


def merge_wants(wants: DataFrame, moves: DataFrame) -> DataFrame:
    """The target's own want stays; a flag that is not set is taken from the source."""
    rows = moved(wants, moves, "movie_id")
    order = first_of()
    flags = rows.groupBy("user_id", "movie_id").agg(F.max_by("added_while_on_screen", F.when(F.col("added_while_on_screen").isNotNull(), order)).alias("flag__"))
    return fold(rows, ["user_id", "movie_id"], order).join(flags, ["user_id", "movie_id"]).withColumn("added_while_on_screen", F.col("flag__")).select(wants.columns)


def merge_watches(watches: DataFrame, moves: DataFrame) -> DataFrame:
    """One watch a user: a rating if there is one, the larger review, the earlier day."""
    rows = moved(watches, moves, "movie_id")
    order = first_of()
    ratings = rows.groupBy("user_id", "movie_id").agg(F.max_by("rating", F.when(F.col("rating").isNotNull(), order)).alias("rating__"))
    return fold(rows, ["user_id", "movie_id"], order, largest=["review_words"], smallest=["watched_at"]).join(ratings, ["user_id", "movie_id"]).withColumn("rating", F.col("rating__")).select(watches.columns)


def merge_ledger(ledger: DataFrame, moves: DataFrame, key: str, unique: Sequence[str]) -> DataFrame:
    """Deliveries move; those that are there already go."""
    return keep_first(moved(ledger, moves, key), unique, ["moved__", *ledger.columns]).select(ledger.columns)


def checked_moves(moves: DataFrame, movies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, refused): movies with different external ids never merge."""
    s, t = (movies.select(F.col("movie_id").alias(c), F.col("tmdb_id").alias(f"{c}_tmdb")) for c in ("source", "target"))
    both = moves.join(s, "source").join(t, "target")
    clash = F.coalesce(F.col("source_tmdb") != F.col("target_tmdb"), F.lit(False))
    return both.filter(~clash).select("source", "target"), both.filter(clash).select("source", "target")
