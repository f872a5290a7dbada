"""Operator 6: packing token pieces into sequences by a configuration program.

The length histogram (at most ``capacity`` numbers, whatever the data's size)
defines a covering program over configurations, that is, multisets of lengths
that fit a sequence: place every length as often as it occurs with the fewest
sequences. Multiplicative weights price lengths: the more of a length's demand is
covered, the less it is worth. A knapsack dynamic program finds the
configurations that are best for the prices, and each takes a small share of what
it covers, rounded to whole sequences, until none takes anything more; what
little remains is placed by best fit. A few passes are made, each starting from
the mean prices of the one before, and the best is taken. Prices divided by the
value of their best configuration are feasible for the dual program, so they bound
the number of sequences from below. Where few pieces of each length are left,
whole sequences fit the fractional program badly; best fit therefore takes over
where that saves most, but not before 95 % of the tokens are placed.

Edge cases: null text is empty and becomes one piece (the end id); rows without
a doc_id and repeated rows are packed each; texts of any length are cut into
pieces as they are read; pieces of one length take their places in the order of
doc_id, piece and checksum, so ties do not matter; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm import bpe
from lumenreel.llm.common import Workspace, table, text_or_empty

CAPACITY = 1024
#: Share of the scarcest length's demand that a configuration takes at once; strength of the weights, and pieces added to a
#: demand before the share of it that is covered is taken (few pieces tell little); how far below the best value a
#: configuration may be to be used with it; passes, and the gap to the bound at which no more are made.
STEP, STRENGTH, SMOOTH, SLACK, PASSES, GAP = 0.02, 6.0, 40, 0.003, 3, 0.001
#: Shares of the tokens after which best fit may take over.
SWITCH = (0.95, 0.97, 0.98, 0.99, 1.0)


#: How often, the places of the lengths it has, and how many of each.
Step = tuple[int, np.ndarray, np.ndarray]


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the greatest price of lengths that fit (repeated at will), and the length taken first,
    the longest of equal ones (-1: leave one free)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits, m = np.searchsorted(lengths, np.arange(capacity + 1), "right"), len(lengths)
    down, worth = lengths[::-1].copy(), prices[::-1].copy()
    for c in range(int(lengths.min()), capacity + 1):
        values = best[c - down[m - fits[c] :]] + worth[m - fits[c] :]
        k = int(values.argmax())
        best[c], pick[c] = (values[k], fits[c] - 1 - k) if values[k] > best[c - 1] else (best[c - 1], -1)
    return best, pick


def follow(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    """Places of the lengths of the best configuration for a room."""
    out = []
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            out.append(int(pick[room]))
            room -= int(lengths[pick[room]])
    return out


def steps(lengths: np.ndarray, demand: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[list[Step], np.ndarray, np.ndarray]:
    """One pass over the program: steps of whole sequences, what no configuration could take (lengths used up), and the mean prices."""
    left, out, mean, total = demand.copy(), [], np.zeros(len(lengths)), 0
    volume = demand * lengths / (demand * lengths).sum()
    while left.any():
        live = np.flatnonzero(left)
        ls, covered, placed = lengths[live], (demand - left) / (demand + SMOOTH), 0
        priced = prices * np.exp(-STRENGTH * (covered - (covered * volume).sum()))
        best, pick = knapsack(priced[live], ls, capacity)
        values = (priced[live] + best[capacity - ls]) / best[capacity]
        for k in np.lexsort((-ls, -values.round(9))).tolist():
            if values[k] < 1 - SLACK and placed:
                break
            used, many = np.unique([k, *follow(pick, ls, capacity - int(ls[k]))], return_counts=True)
            used = live[used]
            most = int((left[used] // many).min())
            if most:
                times = min(most, max(1, int((demand[used] / many).min() * STEP)))
                left[used] -= times * many
                out.append((times, used.astype(np.int32), many.astype(np.int32)))
                placed += times
        if not placed:
            break
        mean, total = mean + placed * priced / best[capacity], total + placed
    return out, left, mean / max(1, total)


def dual_bound(lengths: np.ndarray, demand: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """What the demand is worth at prices at which no configuration is worth more than one."""
    best = knapsack(prices, lengths, capacity)[0][capacity]
    return float((demand * prices).sum() / best) if best > 0 else 0.0


def simple_bound(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """The best of the prices that are feasible as they stand: a length's share of the capacity, but 0 below some edge and 1 beyond the capacity less the edge."""
    bounds = [0.0]
    for edge in range(capacity // 2 + 1):
        price = np.where(lengths < edge, 0, np.where(lengths > capacity - edge, 1, lengths / capacity))
        bounds.append(float((demand * price).sum()))
    return max(bounds)


def _switches(lengths: np.ndarray, demand: np.ndarray, made: list[Step], capacity: int):
    """For each share of the tokens: sequences if best fit goes on from there, the steps until then, and what they leave."""
    done = np.cumsum([t * int((many * lengths[used]).sum()) for t, used, many in made]) / (demand * lengths).sum()
    for share in SWITCH:
        kept, left = made[: int(np.searchsorted(done, share)) + 1], demand.copy()
        for t, used, many in kept:
            left[used] -= t * many
        yield sequences(kept) + sequences(best_fit(lengths, left, capacity)), kept, left


def sequences(made: list[Step]) -> int:
    return sum(step[0] for step in made)


def program(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[list[Step], np.ndarray, float]:
    """The best pass: its steps, what they leave to best fit, and the bound on the number of sequences.

    Lengths that fill a sequence have only one configuration and are placed by it at once.
    """
    full, rest = lengths == capacity, demand.copy()
    rest[full] = 0
    one = [(int(demand[k]), np.array([k]), np.array([1])) for k in np.flatnonzero(full) if demand[k]]
    live = np.flatnonzero(rest)
    if not len(live):
        return one, rest, float(demand[full].sum())
    ls, need, found = lengths[live], rest[live], []
    prices, bound = (ls / capacity) ** 1.3, simple_bound(ls, need, capacity)
    for _ in range(PASSES):
        made, _, prices = steps(ls, need, prices, capacity)
        bound = max(bound, dual_bound(ls, need, prices, capacity))
        found += [(n, len(found) + i, kept, left) for i, (n, kept, left) in enumerate(_switches(ls, need, made, capacity))]
        n = min(f[0] for f in found)
        if n <= np.ceil(bound) + GAP * bound:
            break
    _, _, made, left = min(found, key=lambda x: x[:2])
    rest[live] = left
    return one + [(t, live[used], many) for t, used, many in made], rest, float(demand[full].sum()) + bound


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[Step]:
    """Steps that together place the whole demand exactly."""
    made, left, _ = program(lengths.astype(np.int64), demand.astype(np.int64), capacity)
    return made + best_fit(lengths, left, capacity)


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[Step]:
    """Longest first on the histogram: fill a sequence with the longest lengths that still fit, as often as they last."""
    left, out = left.copy(), []
    while left.any():
        config, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            k = int(np.searchsorted(lengths, room, "right")) - 1
            while k >= 0 and left[k] - config[k] <= 0:
                k -= 1
            if k < 0:
                break
            n = int(min(room // lengths[k], left[k] - config[k]))
            config[k] += n
            room -= n * int(lengths[k])
        used = np.flatnonzero(config)
        times = int((left[used] // config[used]).min())
        out.append((times, used, config[used]))
        left[used] -= times * config[used]
    return out


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = bpe.END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and pid, the task): only a document longer than the capacity is cut, from its end."""
    tokenizer = tokenizer or bpe.default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32())])

    def cut(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for doc_ids, ids in bpe.encode_batches(batches, tokenizer, end_id):
            rows: list[list] = [[] for _ in schema]
            for doc_id, x in zip(doc_ids, ids, strict=True):
                n = len(x) // 4
                start, end = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    for to, v in zip(rows, (doc_id, piece, start, end - start, bpe.crc(x[4 * start : 4 * end]), pid), strict=True):
                        to.append(v)
                    start, end, piece = end, end + capacity, piece + 1
            yield bpe.as_batch(schema, rows)

    return text_or_empty(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int")


def place(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, count: DataFrame | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, pid and any other columns), which must be stored.

    Ranks within a length come from counts by (length, pid) and row numbers within
    them, so no task holds all pieces of a length. The plan of places has at most
    one row for each length and configuration.
    """
    counts = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}).drop("pid")
    lengths = np.array([r.length for r in histogram], np.int64)
    rows, base, seen = [], 0, np.zeros(len(lengths), np.int64)
    for times, used, many in configurations(lengths, np.array([r.n for r in histogram], np.int64), capacity):
        at = 0
        for k, n in zip(used.tolist(), many.tolist(), strict=True):
            rows.append((int(lengths[k]), int(seen[k]), n, base, at))
            seen[k] += times * n
            at += n * int(lengths[k])
        base += times
    by_length: dict[int, list] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(rest)
    firsts = {k: np.array([r[0] for r in v]) for k, v in by_length.items()}

    def find(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                here = length == n
                plan = np.array(by_length[int(n)])[np.searchsorted(firsts[int(n)], rank[here], "right") - 1]
                k = rank[here] - plan[:, 0]
                seq[here], off[here] = plan[:, 2] + k // plan[:, 1], plan[:, 3] + k % plan[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    before = counts.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("before"))
    order = [c for c in ("doc_id", "piece", "ids_crc32", "start") if c in pieces.columns]
    ranked = pieces.withColumn("row", F.row_number().over(Window.partitionBy("length", "pid").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "pid"]).withColumn("rank", F.col("before") + F.col("row")).drop("before", "row", "pid")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    from pyspark.sql.types import LongType, StructField, StructType

    return ranked.mapInArrow(find, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(spark: SparkSession, docs: DataFrame, ws: Workspace, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    pieces = ws.save(pieces_of(docs, tokenizer, capacity), "pieces")
    return place(spark, pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), Workspace(spark, "op6"))
