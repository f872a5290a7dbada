"""Connected components of an edge table, by contraction.

In each round every node points to its smallest neighbour, pointers are followed
a few steps, and edges move to the nodes pointed at; edges inside a group vanish.
Rounds are few because nodes are numbered by a hash. All tables stay distributed
and are written to the shared folder, which cuts lineage. A hub is one key of
partial minima and of joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc", jumps: int = 2) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` (a long, b long) may repeat or loop."""
    edges = ws.save(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        i = len(rounds)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
        up = ws.save(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("root")), f"{name}-p{i}")
        for k in range(jumps):
            to = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            up = ws.save(up.join(to, "root").select("node", F.col("next").alias("root")), f"{name}-p{i}-{k}")
        rounds.append(up)
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias(f"{x}2")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").filter("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = ws.save(moved.distinct(), f"{name}-e{i + 1}")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0]
    for up in rounds[1:]:
        to = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return ws.save(out, f"{name}-out") if len(rounds) > 1 else out
