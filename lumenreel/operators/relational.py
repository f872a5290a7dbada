"""Relational shapes: top-k by key, kept-first rows, pages, ordered lookups, nested results, order-dependent dedupe and joins.

Every order is total: the caller's columns decide, and no row is picked at random.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.session import checkpoint


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered; Spark limits each window group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1, "rank__").drop("rank__")


def keep_last_at_first_place(df: DataFrame, key: str, position: str) -> DataFrame:
    """Union distinct where the last row of a key wins but stands where the first stood."""
    by = Window.partitionBy(key)
    return df.withColumns({"first__": F.min(position).over(by), "last__": F.max(position).over(by)}).filter(F.col(position) == F.col("last__")).withColumn(position, F.col("first__")).drop("first__", "last__")


def page_bounds(total: int, size: int, page: int) -> tuple[int, int, int]:
    """(page, pages, rows to skip), the page held within what there is."""
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return page, pages, (page - 1) * size


def page(df: DataFrame, order: Sequence[Column | str], size: int, skip: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(size)


def exists(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def missing(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a match (except); a null key matches nothing, so its row stays."""
    return df.join(other.select(*on), list(on), "left_anti")


def in_order(ids: Sequence[int], df: DataFrame, key: str) -> DataFrame:
    """Rows of the given ids with their place among them."""
    asked = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], f"{key} {df.schema[key].dataType.simpleString()}, position int")
    return df.join(F.broadcast(asked), key)


def nested(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One row for each key with its rows as a sorted array of structs (the first field decides first)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def flag(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """``df`` with whether ``other`` has its key."""
    return df.join(other.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_by_any_key(df: DataFrame, position: str, keys: Sequence[Column], scope: Sequence[str] = ()) -> DataFrame:
    """In order of ``position`` (unique), drops a row if an earlier kept row has any of its keys; keys of dropped rows do not count.

    Solved in rounds without gathering a group: a row that is the first of all
    its keys among the undecided stays, rows that share a key with it go.
    """
    names = list(scope)
    rows = df.select(position, *names, F.array_distinct(F.filter(F.array(*[k.cast("string") for k in keys]), lambda x: x.isNotNull() & (x != ""))).alias("keys__"))
    keyless = rows.filter(F.size("keys__") == 0).select(position)
    todo = checkpoint(rows.filter(F.size("keys__") > 0).select(position, *names, F.explode("keys__").alias("key__")))
    kept = []
    while not todo.isEmpty():
        first = todo.withColumn("least__", F.min(position).over(Window.partitionBy(*names, "key__")))
        leads = first.groupBy(position).agg(F.max("least__").alias("least__"), F.min("least__").alias("low__")).filter((F.col("least__") == F.col(position)) & (F.col("low__") == F.col(position))).select(position)
        leads = checkpoint(leads)
        taken = todo.join(leads, position, "left_semi").select(*names, "key__").distinct()
        gone = todo.join(taken, [*names, "key__"], "left_semi").select(position).distinct()
        todo = checkpoint(todo.join(gone, position, "left_anti"))
        kept.append(leads)
    return df.join(union_all(keyless, *kept), position, "left_semi")


def join_one_to_one(left: DataFrame, right: DataFrame, left_keys: str, right_keys: str, position: str = "position") -> DataFrame:
    """(left position, right position): each left row, in order, takes the first right row not yet taken under the first of its keys that has one.

    ``left_keys`` and ``right_keys`` are arrays, the left one in order of preference.
    Left rows with the same keys are one kind, and only kinds meet right rows, so equal
    rows on both sides are never stored in pairs. In a round the i-th open row of a kind
    asks for the i-th open right row of that kind's order. It gets it if no earlier row
    of another kind could take it, and all of its kind before it got theirs; the first
    open row always does.
    """
    rows = checkpoint(left.select(F.col(position).alias("l"), F.col(left_keys).alias("keys__")))
    kinds = rows.select("keys__").distinct().select("keys__", F.sha2(F.to_json("keys__"), 256).alias("kind"))
    rows = checkpoint(rows.join(kinds, "keys__").select("l", "kind"))
    a = kinds.select("kind", F.posexplode("keys__").alias("choice", "key"))
    b = right.select(F.col(position).alias("r"), F.explode(right_keys).alias("key"))
    wants = checkpoint(a.join(b, "key").groupBy("kind", "r").agg(F.min("choice").alias("choice")))
    rows, found = checkpoint(rows.join(wants.select("kind").distinct(), "kind", "left_semi")), []
    while not rows.isEmpty():
        asking = rows.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("l")))
        offered = wants.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("choice", "r")))
        # Of the kinds that could take a right row the two whose first open rows come first: one of them is another kind.
        first = wants.join(rows.groupBy("kind").agg(F.min("l").alias("least")), "kind")
        two = top_k(first, ["r"], ["least", "kind"], 2, "place__").groupBy("r").agg(F.min_by("kind", "place__").alias("kind1"), F.min_by("least", "place__").alias("least1"), F.max(F.when(F.col("place__") == 2, F.col("least"))).alias("least2"))
        tried = asking.join(offered.select("kind", "i", "r"), ["kind", "i"]).join(two, "r")
        other = F.when(F.col("kind1") == F.col("kind"), F.col("least2")).otherwise(F.col("least1"))
        before = Window.partitionBy("kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        tried = tried.withColumn("free", F.coalesce(other > F.col("l"), F.lit(True)))
        final = checkpoint(tried.withColumn("all__", F.min(F.col("free").cast("int")).over(before)).filter("all__ = 1").select("l", "r"))
        found.append(final)
        wants = checkpoint(wants.join(final.select("r"), "r", "left_anti"))
        rows = checkpoint(rows.join(final.select("l"), "l", "left_anti").join(wants.select("kind").distinct(), "kind", "left_semi"))
    return union_all(*found) if found else rows.select("l", F.lit(None).cast(right.schema[position].dataType).alias("r"))


def full_one_to_one(left: DataFrame, right: DataFrame, left_keys: str, right_keys: str, position: str = "position") -> DataFrame:
    """(l, r) of the one-to-one join with unmatched rows of both sides."""
    pairs = join_one_to_one(left, right, left_keys, right_keys, position)
    lone = left.select(F.col(position).alias("l")).join(pairs, "l", "left_anti").withColumn("r", F.lit(None).cast(right.schema[position].dataType))
    rest = right.select(F.col(position).alias("r")).join(pairs, "r", "left_anti").select(F.lit(None).cast(left.schema[position].dataType).alias("l"), "r")
    return pairs.unionByName(lone).unionByName(rest)


def fold_best(df: DataFrame, keys: Sequence[str], score: Column, position: str, fill: Sequence[str]) -> DataFrame:
    """Duplicates of a key as one row: the best by score (the first on ties), its empty columns filled from the best row that has them."""
    order = F.struct(score, -F.col(position))
    others = [c for c in df.columns if c not in {*keys, *fill}]
    best = [F.max_by(c, order).alias(c) for c in others]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)).alias(c) for c in fill]
    return df.groupBy(*keys).agg(*best, *filled).select(*df.columns)


def dedupe_rows(df: DataFrame, own_id: Column, parts: Sequence[Column], position: str) -> DataFrame:
    """The first row of each id, or, where a row has none, of each combination of its parts."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    own = F.nullif(text(own_id), F.lit(""))
    key = F.when(own.isNotNull(), F.struct(F.lit("id").alias("kind"), own.alias("key"))).otherwise(F.struct(F.lit("parts").alias("kind"), F.concat_ws("|", *map(text, parts)).alias("key")))
    return keep_first(df.withColumn("row_key__", key), ["row_key__"], [position]).drop("row_key__")


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Parents with the number of their rows in each child table (with ``key``); counts are taken before each join."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def with_optional(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Rows with the columns of a lookup table; a key that is null or unknown keeps its row."""
    return df.join(lookup, on, "left")


def any_of(df: DataFrame, *conditions: tuple[Column, DataFrame | None, bool], key: str) -> DataFrame:
    """Rows that meet any of several conditions: a column, and where a table is given, whether the key is in it (True) or not."""
    names = []
    for i, (plain, table, wanted) in enumerate(conditions):
        met = plain
        if table is not None:
            df = flag(df, table, [key], f"in{i}__")
            names.append(f"in{i}__")
            met = plain & (F.col(f"in{i}__") == wanted)
        df = df.withColumn(f"met{i}__", F.coalesce(met, F.lit(False)))
        names.append(f"met{i}__")
    return df.filter(" or ".join(n for n in names if n.startswith("met"))).drop(*names)


def by_locale(df: DataFrame, text: str, *ties: str) -> DataFrame:
    """Rows in the order of a language's readers rather than of code points."""
    return df.orderBy(F.collate(F.col(text), "UNICODE"), *ties)


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """Positive ids, each once."""
    return df.select(key).filter(F.col(key) > 0).distinct()


def numbered(df: DataFrame, order: Sequence[str], name: str, after: int = 0) -> DataFrame:
    """Rows numbered from ``after + 1`` in order: ranges are counted first, so no task holds all rows."""
    ranges = checkpoint(df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()))
    sizes = ranges.groupBy("range__").agg(F.count(F.lit(1)).alias("n__"))
    before = sizes.select("range__", (F.sum("n__").over(Window.orderBy("range__")) - F.col("n__")).alias("before__"))
    within = F.row_number().over(Window.partitionBy("range__").orderBy(*order))
    return ranges.join(F.broadcast(before), "range__").withColumn(name, F.col("before__") + within + after).drop("range__", "before__")
