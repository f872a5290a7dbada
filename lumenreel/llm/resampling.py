"""Operator 12: importance resampling towards a target distribution, over hashed features.

Two passes of Arrow batches. The first hashes the features of each partition's
texts (runs of words) into buckets and counts them with ``np.bincount``; one vector
a partition is merged by ``treeReduce``. Vectors of the documents and of the target
give each bucket a gain, the logarithm of how much likelier it is in the target. The
second pass has the gains broadcast (as many numbers as there are buckets, whatever
the input), gathers them by bucket and sums them by document with bincount's weights.

Drawing without replacement is a choice of the highest sums of weight and Gumbel
noise; the noise is a function of a seed and the document's id, so reruns agree. The
draw's order is one sort by ranges; places come from the counts of the ranges.

Edge cases: null texts have no words; a row without a doc_id takes the noise of the
empty id and stands behind rows with one where scores are equal; rows that share an
id share their noise, and stand by weight, then by features; a text of any length is read
whole, about a megabyte at a time; an empty table, or an empty target, gives defined
gains (all buckets of a side count as equally likely) and no rows or zero draws;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, ordered, small_batches, table
from lumenreel.llm.spelling import CRC32, bytes_of, crc32_of

BUCKETS = 10_000
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
#: Letters, digits and all bytes beyond ASCII stand for themselves, lower-cased in ASCII; the rest parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_stretches(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time, none cut."""
    clean, at = raw.translate(_WORDS), 0
    while at < len(clean):
        end = clean.find(b" ", at + STRETCH)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def feature_buckets(raw: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of stretches of a text; a feature is a run of 1 to ``longest`` words."""
    held: list[bytes] = []
    for words in word_stretches(raw):
        run = held + words
        after = [b" " + w for w in run]
        sums = list(map(crc32, run))
        found = [sums[len(held) :]]
        for k in range(1, longest):
            sums = list(map(crc32, after[k:], sums))
            found.append(sums[max(0, len(held) - k) :])
        yield len(words), np.fromiter((x for some in found for x in some), np.int64) % buckets
        held = run[len(run) - (longest - 1) :] if longest > 1 and len(run) >= longest else run if longest > 1 else []


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Texts of a batch as bytes, null as none."""
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()))


def bucket_counts(df: DataFrame, longest: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _texts(batch):
                for _, found in feature_buckets(raw, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = df.select("text").mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(ratio)) of each bucket's share, smoothed by one, in the target to that in the documents."""
    below, above = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    ratio = ((t + 1.0) * below / ((s + 1.0) * above) for s, t in zip(raw.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.float64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Noise of a document: floor(-1000 ln(-ln u)), u of the first 32 bits of a digest."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document; sums stay whole numbers below 2^53."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def score(batches):
        value = sent.value
        for batch in batches:
            n = batch.num_rows
            words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            parts, size = [], 0

            def add():
                of = np.repeat([i for i, _ in parts], [len(f) for _, f in parts])
                return np.bincount(of.astype(np.int64), weights=value[np.concatenate([f for _, f in parts])], minlength=n)

            for i, raw in enumerate(_texts(batch)):
                for many, found in feature_buckets(raw, longest, buckets):
                    words[i] += many
                    features[i] += len(found)
                    parts.append((i, found))
                    size += len(found)
                    if size >= STRETCH:
                        sums += add()
                        parts, size = [], 0
            if parts:
                sums += add()
            weight = np.floor_divide(sums.astype(np.int64), np.maximum(features, 1))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            noise = np.array([gumbel(seed, d) for d in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, (words, features, weight, weight + noise))], ["doc_id", "n_words", "n_features", "weight", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, seed: int = 7, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight, score, and its place in the draw (null where it is not drawn).

    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = ws.save(weigh(docs, gain, seed, longest), "scored")
    able = F.col("n_words") >= least_words
    placed, n = ordered(scored.filter(able), ws, "draw", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").asc(), F.col("n_features").asc())
    drawn = placed.withColumn("rank", F.when(F.col("at") < n * percent // 100, F.col("at") + 1))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.drop("at").unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op12"))


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_FOUND = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{_PATTERN}')"


def _features(name: str, ident: str) -> str:
    return f"""
  SELECT {ident}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {ident}, {_FOUND} AS w FROM {name})"""


ORACLE = f"""
WITH {CRC32},
rawf AS ({_features("documents", "doc_id")}),
aimf AS ({_features("benchmark", "item_id")}),
spelled AS (SELECT f, {crc32_of(bytes_of("f"))} % {BUCKETS} AS bucket FROM (SELECT f FROM rawf UNION SELECT f FROM aimf), steps),
raw AS (SELECT doc_id, bucket, count(*) AS n FROM rawf JOIN spelled USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM raw GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aimf JOIN spelled USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + {BUCKETS}) / ((s + 1) * (all_t + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM raw JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    coalesce(len({_FOUND}), 0) AS n_words,
    ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id
),
final AS (SELECT doc_id, n_features, weight, n_words, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 25 // 100 AS most FROM final WHERE n_words >= 20
)
SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM final f LEFT JOIN placed p ON p.doc_id = f.doc_id
"""
