"""Operator 7: exact top-k inner products by distributed histogram selection.

Vectors become integers, floor(scale * x). Blocks of queries meet blocks of
candidates; each meeting scores all its pairs and sends only histogram counts
down to its own k-th score. Summed over blocks these locate, in a few rounds of
ever finer bins, each query's exact k-th score; a last pass sends the pairs at
or above it, ties at it limited to the k smallest ids of the block, which is
lossless.

Edge cases: vectors that are null or hold null or non-finite components take no
part; vectors of different length are not compared; rows that share the query's
id are not its candidates; different rows with one id are queries of their own
(each has its answers, under that id), equal ones are one query; repeated
candidates are returned each; with fewer candidates than k all are returned;
components so large that inner products could leave 64 bits raise an error;
other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, table

K, SCALE, EVERY, BINS = 20, 64, 20, 256
QUERY_BLOCK, ROW_BLOCK = 1024, 8192


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & ok).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.size("embedding").alias("dim"))


def blocks(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """Rows dealt by id into blocks of about ``size``: one row per block with its ids and vectors."""
    many = max(1, -(-n // size))

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        v = np.stack(pdf.v.to_list()) if key[0] else np.zeros((len(pdf), 0))
        own = {"own": [pdf.own.to_numpy(np.int64).tobytes()]} if "own" in pdf else {}
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], **own, f"{name}_ids": [pdf.vec_id.to_numpy(np.int64).tobytes()], f"{name}_v": [v.astype(narrow(v)).tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int"))
    return dealt.groupBy("dim", name).applyInPandas(join, f"dim int, {name} int, {'own binary, ' if 'own' in rows.columns else ''}{name}_ids binary, {name}_v binary")


def narrow(v: np.ndarray) -> type:
    most = np.abs(v).max(initial=0)
    return np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64


def wide(data: bytes, n: int, dim: int) -> np.ndarray:
    size = len(data) // (n * dim) if n * dim else 8
    return np.frombuffer(data, f"i{size}").reshape(n, dim)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    norm = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0)) * np.sqrt((c.astype(float) ** 2).sum(1).max(initial=0))
    kind = np.float32 if norm < 2**23 else np.float64 if norm < 2**52 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64 if kind == np.int64 or norm >= 2**31 else np.int32)


def _meet(row, step: int = 128):
    """(query ids, candidate ids, scores, own) for a few queries at a time; own marks pairs of one id."""
    q_ids, q_own, c_ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "own", "c_ids"))
    q, c = (wide(row[x], len(i), row["dim"]) for x, i in (("q_v", q_ids), ("c_v", c_ids)))
    for at in range(0, len(q_ids), step):
        yield q_ids[at : at + step], c_ids, scores(q[at : at + step], c), q_own[at : at + step, None] == c_ids[None, :]


def _known(row, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the queries' bins, and whether each has one."""
    at = dict(zip(np.frombuffer(row["s_ids"], np.int64).tolist(), np.frombuffer(row["s_lo"], np.int64).tolist(), strict=True))
    return np.array([at.get(i, 0) for i in ids.tolist()], np.int64), np.array([i in at for i in ids.tolist()], bool)


def exact_top_k(spark: SparkSession, queries: DataFrame, rows: DataFrame, ws: Workspace, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query; both sides (vec_id, v array<long>, dim)."""
    # Rows that share an id and differ are queries of their own; equal ones are one query.
    queries = ws.save(queries.select("vec_id", "v", "dim").distinct().withColumn("own", F.col("vec_id")).withColumn("vec_id", F.monotonically_increasing_id()), "queries")
    n_q, n_c = queries.count(), rows.count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n_q or not n_c:
        return spark.createDataFrame([], empty)
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first().m
    top = max(top, queries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first().m)
    # Squared norms are summed in doubles; the bound stands above what they may have lost.
    bound = int(max(top, 1.0) * (1 + 2.0**-40)) + 1
    if bound >= 2**62:
        raise ValueError("inner products of these components leave the range of 64-bit integers")
    q = ws.save(blocks(queries, n_q, QUERY_BLOCK, "q"), "q")
    c = ws.save(blocks(rows, n_c, ROW_BLOCK, "c"), "c")
    many = q.count()
    # Every block of candidates is sent to each block of queries: a stated query set against all rows.
    pairs = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n_q // QUERY_BLOCK)) - 1)))).join(q, ["dim", "q"]).repartition(max(2, min(many * c.count(), 4096)), "q", "c")
    pairs = pairs.select("dim", "q", "own", "q_ids", "q_v", "c_ids", "c_v")

    # Bins are powers of two wide, so scores fall into them by a shift, as whole numbers throughout.
    was, low, shift = None, -bound, max(0, (2 * bound // BINS).bit_length())
    state = None  # by query: bin that holds the k-th score [lo, lo + width), and how many are above it
    while True:
        def histogram(batches, low=low, shift=shift, n=BINS + 1 if state is None else 1 << (was - shift), first=state is None):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    for ids, _, s, own in _meet(row):
                        base, has = (np.full(len(ids), low), np.ones(len(ids), bool)) if first else _known(row, ids)
                        b = (s.astype(np.int64) - base[:, None]) >> shift
                        keep = ~own & (b >= 0) & (b < n) & has[:, None]
                        flat = (np.arange(len(ids))[:, None] * n + b)[keep]
                        count = np.bincount(flat, minlength=len(ids) * n).reshape(len(ids), n)
                        above = np.cumsum(count[:, ::-1], axis=1)[:, ::-1] - count
                        i, j = np.nonzero((count > 0) & (above < k))
                        yield pd.DataFrame({"query_id": ids[i], "bin": j, "n": count[i, j]})

        given = pairs if state is None else pairs.join(state_blocks(state, n_q), "q")
        width = F.lit(1 << shift).cast("long")
        counts = given.mapInPandas(histogram, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(w))
        if state is None:
            found = counts.withColumns({"lo": F.lit(low).cast("long") + F.col("bin").cast("long") * width, "base": F.lit(0).cast("long")})
        else:
            found = counts.join(state.select("query_id", F.col("lo").alias("lo0"), F.col("above").alias("base")), "query_id").withColumn("lo", F.col("lo0") + F.col("bin").cast("long") * width)
        # The bin in which the count reaches k; the lowest one, if there are fewer.
        hit = F.when(F.col("base") + F.col("upto") >= k, F.struct(F.lit(1).alias("full"), F.col("bin").alias("bin"))).otherwise(F.struct(F.lit(0).alias("full"), (-F.col("bin")).alias("bin")))
        best = found.groupBy("query_id").agg(F.max_by(F.struct("lo", (F.col("base") + F.col("upto") - F.col("n")).alias("above")), hit).alias("b"))
        state = ws.save(best.select("query_id", "b.lo", "b.above"), f"state{shift}")
        if shift == 0:
            break
        was, shift = shift, max(0, shift - BINS.bit_length() + 1)

    def keep(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                for ids, c_ids, s, own in _meet(row):
                    kth, has = (x[:, None] for x in _known(row, ids))
                    tied = ~own & has & (s == kth)
                    take = (~own & has & (s > kth)) | (tied & (np.cumsum(tied, axis=1) <= k))  # candidates stand in the order of ids
                    i, j = np.nonzero(take)
                    yield pd.DataFrame({"query_id": ids[i], "vec_id": c_ids[j], "score": s[i, j].astype(np.int64)})

    best = pairs.join(state_blocks(state, n_q), "q").mapInPandas(keep, "query_id long, vec_id long, score long")
    own = queries.select(F.col("vec_id").alias("query_id"), "own")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.join(own, "query_id").select(F.col("own").alias("query_id"), "rank", "vec_id", "score")


def state_blocks(state: DataFrame, n_q: int) -> DataFrame:
    """The selection's state dealt as the queries are; queries without candidates have none."""
    many = max(1, -(-n_q // QUERY_BLOCK))

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"q": [key[0]], "s_ids": [pdf.query_id.to_numpy(np.int64).tobytes()], "s_lo": [pdf.lo.to_numpy(np.int64).tobytes()]})

    return state.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int")).groupBy("q").applyInPandas(join, "q int, s_ids binary, s_lo binary")


def op7_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"))
    return exact_top_k(spark, rows.filter(F.col("vec_id") % EVERY == 0), rows, Workspace(spark, "op7"))


ORACLE = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x) for x in embedding::DOUBLE[]] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
