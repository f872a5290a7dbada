"""Operator 3: quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; a word's context vector is the sum
of its neighbours' index vectors over the whole corpus. Words are runs of
letters, digits or signs, hashed into a fixed number of rows, so the vectors fit
a fixed bound (ROWS x DIM) whatever the corpus. Documents pool their words'
vectors; a two-layer network scores them, and a temperature fitted on labelled
rows that the network has not seen calibrates its probabilities.

Edge cases: null and empty texts pool to zeros and get the score of that point;
very long texts are pooled whole; ``held_out`` is null, and labels are not
learned from, where doc_id is null; repeated documents are scored each, and equal
texts get equal scores; of repeated labels of one id the greatest counts, and of
documents that share it at most the bound are learned from, all told; labels that are null, and labelled rows
without a document, are left out; with labels of one kind only, or none, every
score is the share of label 1 (0.5 without labels); an empty table gives no
rows; other columns are ignored, a column ``score`` too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import small_batches, table, text_or_empty, trim
from lumenreel.llm.runs import KIND, word_hashes

ROWS, DIM, NONZERO, REACH, PARTS = 1 << 14, 32, 4, 2, 16
#: The most labelled rows, after the join with documents, that the network is fitted on.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 3


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's non-zero components."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def context_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors and counts of all rows, summed over all documents.

    Each task adds up one matrix of fixed size; matrices are added in parts.
    """

    def add(batches):
        at, sign = index_vectors()
        total, seen = np.zeros(ROWS * DIM), np.zeros(ROWS, np.int64)
        for batch in batches:
            for _, _, h, offsets in word_hashes(batch.column(0).to_pylist(), lower=False, classes=KIND):
                b = (h >> np.uint64(50)).astype(np.int64)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                seen += np.bincount(b, minlength=ROWS)
                for o in range(1, REACH + 1):
                    same = doc[o:] == doc[:-o]
                    left, right = b[:-o][same], b[o:][same]
                    for x, y in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(x * DIM + at[y, k], weights=sign[y, k], minlength=ROWS * DIM)
        whole = np.concatenate([total.reshape(ROWS, DIM), seen[:, None]], axis=1).astype(np.int64).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([zlib.compress(x.astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes(), 1) for x in whole], pa.binary())], names=["part", "m"])
        trim()

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(_matrix(x) for x in pdf.m)
        return pd.DataFrame({"part": [key[0]], "m": [zlib.compress(np.ascontiguousarray(total).reshape(-1, 1).view(np.uint8).T.tobytes(), 1)]})

    parts = text_or_empty(docs).select("text").mapInArrow(add, "part int, m binary")
    # A few matrices at a time: sums by part and group of tasks first, then by part.
    parts = parts.withColumn("some", F.pmod(F.xxhash64("m"), F.lit(32)).cast("int")).groupBy("part", "some").applyInPandas(merge, "part int, m binary")
    found = {r.part: _matrix(r.m) for r in parts.groupBy("part").applyInPandas(merge, "part int, m binary").collect()}  # ROWS x (DIM + 1) numbers
    if not found:
        return np.zeros((ROWS, DIM)), np.zeros(ROWS)
    whole = np.concatenate([found[p] for p in range(PARTS)]).reshape(ROWS, DIM + 1).astype(float)
    return whole[:, :DIM], whole[:, DIM]


def _matrix(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def word_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Unit context vectors around their common mean, beside the index vectors, weighted down for frequent words."""
    at, sign = index_vectors()
    index = np.zeros((ROWS, DIM))
    np.add.at(index, (np.arange(ROWS)[:, None], at), sign / np.sqrt(NONZERO))
    context = sums / np.maximum(1, seen)[:, None]
    context -= (context * seen[:, None]).sum(0) / max(1.0, seen.sum())
    context /= np.maximum(1e-9, np.linalg.norm(context, axis=1))[:, None]
    weight = 1 / (1 + seen / max(1.0, seen.sum()) * 1000)
    return np.concatenate([np.concatenate([context, index], axis=1) * weight[:, None], np.ones((ROWS, 1))], axis=1).astype(np.float32)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text and two lengths of it."""
    out = np.zeros((len(texts), vectors.shape[1] + 1), np.float64)
    for first, last, h, offsets in word_hashes(texts, lower=False, classes=KIND):
        b = (h >> np.uint64(50)).astype(np.int64)
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        sums = np.zeros((last - first, vectors.shape[1]))
        for lo in range(0, len(full), 64):
            some = full[lo : lo + 64]
            start, end = offsets[some[0]], offsets[some[-1] + 1]
            sums[some] = np.add.reduceat(vectors[b[start:end]], offsets[some] - start, axis=0)
        mean = sums / np.maximum(1, n)[:, None]
        mean[:, -1] = np.log1p(n)
        out[first:last, :-1] = mean
        out[first:last, -1] = np.linalg.norm(mean[:, :DIM], axis=1)
    return out


class Network:
    """Two layers, tanh and a calibrated sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.share = float(y.mean()) if len(y) else 0.5
        self.temperature, self.flat = 1.0, not len(y) or y.min() == y.max()
        if self.flat:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        z, hold = (x - self.mid) / self.scale, rng.random(len(x)) < 0.2
        hold &= len(x) >= 50
        weights = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        zt, yt = z[~hold], y[~hold]
        for _ in range(EPOCHS):
            order = rng.permutation(len(zt))
            for at in range(0, len(order), 256):
                a, t = zt[order[at : at + 256]], yt[order[at : at + 256]]
                hid = np.tanh(a @ weights[0] + weights[1])
                g = (_sigmoid(hid @ weights[2] + weights[3][0]) - t) / len(t)
                back = g[:, None] * weights[2] * (1 - hid**2)
                grads, step = [a.T @ back + 1e-4 * weights[0], back.sum(0), hid.T @ g + 1e-4 * weights[2], np.array([g.sum()])], step + 1
                for i, d in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    weights[i] = weights[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = weights
        if hold.any():
            logits = self.logits(x[hold])
            loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - y[hold] * logits / t))
            self.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        hid = np.tanh(np.clip((x - self.mid) / self.scale, -20, 20) @ self.weights[0] + self.weights[1])
        return hid @ self.weights[2] + self.weights[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.flat else _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents; the network from at most ``most`` labelled rows that are not held out."""
    small_batches(spark)
    vectors = word_vectors(*context_sums(docs))
    sample = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            ids, y = batch.column(0), batch.column(1)
            x = pool(batch.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([ids, y, pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = text_or_empty(docs).join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("double").alias("y"), "text").mapInArrow(features, "doc_id long, y double, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, "<f4") for r in rows], float) if rows else np.zeros((0, vectors.shape[1] + 1))
    return vectors, Network(x, np.array([r.y for r in rows]))


def score(spark: SparkSession, docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "score") -> DataFrame:
    """docs (doc_id, text and others) with the score of every whole text in a column ``name``, which replaces one of that name."""
    model = spark.sparkContext.broadcast((vectors, network))
    columns = [c for c in docs.columns if c != name]
    at = columns.index("text")

    def apply(batches):
        vectors, network = model.value
        for batch in batches:
            s = network(pool([t or "" for t in batch.column(at).to_pylist()], vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*columns, name])
        trim()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.select(columns).mapInArrow(apply, StructType([*docs.select(columns).schema.fields, StructField(name, DoubleType())]))


def op3_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(spark, docs, *fit(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
