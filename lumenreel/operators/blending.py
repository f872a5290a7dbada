"""Records of one thing from several sources as one record, whatever order they arrive in.

``rank`` orders sources (the smaller goes first), ``position`` orders records of one
source. Every field is an aggregate over that order, so Spark combines records before
the shuffle; lists keep the order of first appearance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions.text import clean


@dataclass(frozen=True)
class Blend:
    """What becomes of each field.

    ``first`` and ``last``: the first or last value that is known (empty texts are not,
    zeros are not for ``first`` and ``last``); ``known``: the first that is not null;
    ``longest``: the longest cleaned text, the first of equally long ones; ``longer``: the
    first text, unless another is longer by more than a margin; ``any``: true if any is;
    ``union``: lists without repetitions; ``events``: lists of structs, one for each key
    (fields whose cleaned texts make it).
    """

    first: Sequence[str] = ()
    last: Sequence[str] = ()
    known: Sequence[str] = ()
    longest: Sequence[str] = ()
    longer: dict[str, int] = field(default_factory=dict)
    any: Sequence[str] = ()
    union: Sequence[str] = ()
    events: dict[str, Sequence[str]] = field(default_factory=dict)


def _said(c: str) -> Column:
    """A value that says something, as a condition."""
    text = F.col(c).cast("string")
    return F.coalesce((F.trim(text) != "") & ~text.isin("0", "0.0", "false"), F.lit(False))


def _list_union(rows: DataFrame, keys: Sequence[str], column: str, order: Column, parts: Sequence[str] | None) -> DataFrame:
    """``keys`` and the union of a list: each element once, where it first stood."""
    at = rows.select(*keys, order.alias("order__"), F.posexplode(column).alias("at__", "x__"))
    same = F.struct(*[clean(F.coalesce(F.col(f"x__.{p}").cast("string"), F.lit(""))).alias(p) for p in parts]) if parts else F.struct("x__")
    once = at.filter(F.col("x__").isNotNull()).groupBy(*keys, same.alias("same__")).agg(F.min_by("x__", F.struct("order__", "at__")).alias("x__"), F.min(F.struct("order__", "at__")).alias("order__"))
    ordered = F.array_sort(F.collect_list(F.struct("order__", "x__"))) if not parts else F.transform(F.array_sort(F.collect_list(F.struct("order__", F.to_json(F.struct("x__")).alias("tie__"), "x__"))), lambda v: F.struct(v.order__, v.x__))
    return once.groupBy(*keys).agg(F.transform(ordered, lambda v: v.x__).alias(column))


def blend(rows: DataFrame, keys: Sequence[str], how: Blend, rank: str = "rank", position: str = "position") -> DataFrame:
    """One row for each key: keys and the fields of ``how``."""
    order = F.struct(F.col(rank), F.col(position))
    texts = {c: clean(F.coalesce(F.col(c), F.lit(""))) for c in (*how.longest, *how.longer)}
    # Reversed for the aggregates that take a maximum: the first in order is the greatest.
    back = F.struct((-F.col(rank)).alias("r"), (-F.col(position)).alias("p"))
    out = [F.min_by(c, F.when(_said(c), order)).alias(c) for c in how.first]
    out += [F.max_by(c, F.when(_said(c), order)).alias(c) for c in how.last]
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in how.known]
    out += [F.max_by(texts[c], F.when(texts[c] != "", F.struct(F.char_length(texts[c]).alias("n"), back.alias("b")))).alias(c) for c in how.longest]
    out += [F.coalesce(F.max(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(c) for c in how.any]
    for c in how.longer:
        own = F.min_by(texts[c], F.when(texts[c] != "", order)).alias(f"{c}__own")
        best = F.max_by(texts[c], F.when(texts[c] != "", F.struct(F.char_length(texts[c]).alias("n"), back.alias("b")))).alias(f"{c}__best")
        out += [own, best]
    found = rows.groupBy(*keys).agg(*out) if out else rows.select(*keys).distinct()
    for c, margin in how.longer.items():
        longer = F.char_length(f"{c}__best") > F.char_length(f"{c}__own") + margin
        found = found.withColumn(c, F.when(longer, F.col(f"{c}__best")).otherwise(F.col(f"{c}__own"))).drop(f"{c}__own", f"{c}__best")
    for c in (*how.union, *how.events):
        lists = _list_union(rows, keys, c, order, how.events.get(c))
        same = [found[k].eqNullSafe(lists[k]) for k in keys]
        found = found.join(lists, same, "left").select(*[found[x] for x in found.columns], F.coalesce(lists[c], F.array().cast(rows.schema[c].dataType)).alias(c))
    return found
