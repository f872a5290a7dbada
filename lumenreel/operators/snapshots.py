"""Changes of stored tables as new snapshots: upsert, insert-if-absent, tombstones, expiry, backfills, bridges.

A change is a join of the snapshot with what came in; writing the result and
swapping it in is the transaction. Batch sizes of row stores have no meaning here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.operators.predicates import moment, upcoming
from lumenreel.operators.relational import flag, keep_first, missing


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), reset: dict[str, Column] | None = None) -> DataFrame:
    """``stored`` with ``incoming`` (unique by key) over it: its columns win, except ``keep`` ones that are already set; ``reset`` ones are set anew on every incoming row."""
    values = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"{c}__") for c in values if c in incoming.columns], F.lit(True).alias("came__"))
    joined = stored.withColumn("was__", F.lit(True)).join(new, list(keys), "full_outer")
    came = F.col("came__").isNotNull()
    out = []
    for c in values:
        if c in (reset or {}):
            out.append(F.when(came, reset[c]).otherwise(F.col(c)).alias(c))
        elif c not in incoming.columns:
            out.append(F.col(c))
        elif c in keep:
            out.append(F.coalesce(c, f"{c}__").alias(c))
        else:
            out.append(F.when(came, F.col(f"{c}__")).otherwise(F.col(c)).alias(c))
    return joined.select(*keys, *out).select(stored.columns)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Adds rows whose key is not there yet; of several with one key the first."""
    return stored.unionByName(missing(keep_first(incoming, keys, order), stored, keys).select(stored.columns))


def tombstone_missing(stored: DataFrame, current: DataFrame, key: str, scope: Column, start: str, status: str, now: str, days: int = 120, scheduled: str = "SCHEDULED", canceled: str = "CANCELED") -> DataFrame:
    """Scheduled rows of the scope within the next days whose key is not in ``current`` become canceled; rows without a key never do."""
    window = (F.col(start) >= moment(now)) & (F.col(start) <= moment(now) + F.make_dt_interval(F.lit(days)))
    marked = flag(stored, current.filter(F.col(key).isNotNull()), [key], "seen__")
    gone = scope & window & (F.col(status) == scheduled) & F.col(key).isNotNull() & ~F.col("seen__")
    return marked.withColumn(status, F.when(gone, F.lit(canceled)).otherwise(F.col(status))).select(stored.columns)


def backfill_end(rows: DataFrame, start: str, end: str, runtime: str, movie_runtime: str) -> DataFrame:
    """Missing ends from the row's own runtime, else the movie's; an own runtime of 0 is kept and gives none."""
    minutes = F.coalesce(runtime, movie_runtime)
    return rows.withColumn(end, F.coalesce(end, F.when(minutes > 0, F.col(start) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int")))))


def canonical_by_slug(rows: DataFrame, slug: str, updated: str, key: str) -> DataFrame:
    """Of rows whose slugs differ in case only: the exact lower-case one first, then the newest, then the highest key; in the order of first appearance."""
    low = F.lower(F.trim(F.col(slug)))
    exact = F.col(slug) == low
    ranked = rows.withColumn("slug__", low).filter(F.col("slug__") != "")
    first = F.min("position").over(Window.partitionBy("slug__"))
    return keep_first(ranked.withColumns({"exact__": exact, "first__": first}), ["slug__"], [F.desc("exact__"), F.col(updated).desc_nulls_last(), F.desc(key)]).withColumn(slug, F.col("slug__")).withColumn("position", F.col("first__")).drop("slug__", "exact__", "first__")


def fold_by_slug(theaters: DataFrame, children: DataFrame, slug: str, updated: str, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Theaters folded by slug, and their child rows pointed at the ones that stay."""
    kept = canonical_by_slug(theaters, slug, updated, key)
    to = theaters.select(F.col(key).alias(child_key), F.lower(F.trim(slug)).alias("slug__")).join(kept.select(F.col(slug).alias("slug__"), F.col(key).alias("to__")), "slug__")
    moved = children.join(to.select(child_key, "to__"), child_key, "left")
    return kept, moved.withColumn(child_key, F.coalesce("to__", child_key)).select(children.columns)


def fill_links(stored: DataFrame, incoming: DataFrame, key: str, links: Sequence[str]) -> DataFrame:
    """Empty links (null or empty text) filled from the incoming row."""
    new = incoming.select(key, *[F.col(c).alias(f"{c}__") for c in links])
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"{c}__")) for c in links}
    return stored.join(new, key, "left").withColumns(filled).select(stored.columns)


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Bridge rows of the given parents replaced. Without ``parents`` only parents that bring rows are touched."""
    touched = incoming.select(parent) if parents is None else parents.select(parent)
    return missing(stored, touched.distinct(), [parent]).unionByName(incoming.select(stored.columns).distinct())


def drop_children(child: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Cascade of a delete: children whose parent is gone go too."""
    return child.join(parents.select(F.col(key).alias(child_key)), child_key, "left_semi")


def without_orphans(people: DataFrame, key: str, external: str, *references: DataFrame) -> DataFrame:
    """Rows without an external id that nothing refers to go."""
    lone = people.filter(F.col(external).isNull())
    for r in references:
        lone = missing(lone, r, [key])
    return missing(people, lone, [key])


def add_wants(stored: DataFrame, asked: DataFrame, on_screen: DataFrame, user: str, movie: str) -> DataFrame:
    """New (user, movie) wants; each remembers whether the movie was on screen then."""
    fresh = missing(asked.select(user, movie).distinct(), stored, [user, movie])
    return stored.unionByName(flag(fresh, on_screen, [movie], "added_while_on_screen"), allowMissingColumns=True)


def remove(stored: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return missing(stored, keys, on)


def mark_watched(stored: DataFrame, incoming: DataFrame, user: str, movie: str, overwrite: bool) -> DataFrame:
    """Watches upserted: an update in place overwrites rating and review, also with nothing; an import keeps what is there."""
    values = [c for c in stored.columns if c not in (user, movie)]
    return upsert(stored, incoming, [user, movie], keep=() if overwrite else values)


def initial_flags(wants: DataFrame, on_screen: DataFrame, movie: str, name: str = "added_while_on_screen") -> DataFrame:
    """Flags that are not set yet, from whether the movie is on screen."""
    return flag(wants, on_screen, [movie], "now__").withColumn(name, F.coalesce(name, "now__")).drop("now__")


def close_posts(posts: DataFrame, asked: DataFrame, key: str, now: str) -> DataFrame:
    """Closed posts keep the time of their first close."""
    hit = flag(posts, asked, [key], "hit__")
    return hit.withColumns({"closed_at": F.when(F.col("hit__"), F.coalesce("closed_at", moment(now))).otherwise(F.col("closed_at")), "status": F.when(F.col("hit__"), F.lit("CLOSED")).otherwise(F.col("status"))}).select(posts.columns)


def upsert_posts(posts: DataFrame, incoming: DataFrame, showtimes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(posts, posts that are new or active again). Only posts for upcoming showtimes count; price and seat belong to SELL posts."""
    keys = ["user_id", "showtime_id", "type"]
    sell = F.col("type") == "SELL"
    open_now = showtimes.filter(upcoming(F.col("start"), F.col("status"), now)).select("showtime_id")
    valid = incoming.filter(F.col("type").isin("BUY", "SELL") & F.col("quantity").between(1, 100)).join(open_now, "showtime_id", "left_semi")
    valid = valid.withColumns({"price_cents": F.when(sell, F.col("price_cents")), "seat_info": F.when(sell, F.col("seat_info")), "status": F.lit("ACTIVE"), "closed_at": F.lit(None).cast("timestamp_ntz"), "updated_at": moment(now)})
    active = posts.filter("status = 'ACTIVE'")
    return upsert(posts, valid, keys), missing(valid, active, keys)
