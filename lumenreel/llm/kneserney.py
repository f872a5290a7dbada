"""Operator 4: an interpolated modified Kneser-Ney word model of order two.

Counting, merging and smoothing statistics are Spark jobs over sorted hash
arrays: every task counts what it reads, cuts its sorted counts by hash range,
and each range is merged and written as one file of the shared folder. Workers
map the files into memory to score whole texts. Words get dense numbers (their
place in the sorted array of word hashes), so statistics by word are plain
arrays.

Order two: the model keeps all bigrams of the corpus without pruning.

Edge cases: null text counts as empty (only the end token); rows without a doc_id
have ``held_out`` null and are trained on; texts of any length are counted and
scored whole; repeated rows are trained on and scored each, equal texts alike; with no training documents N = V = 0 and every word
has probability 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, local_path, mix64, n_shards, pack, shard_of, table, text_or_empty, unpack, write_file
from lumenreel.llm.runs import word_hashes

END = np.uint64(0x1E5C0DE5EED5E17D)
#: Counts held by a task before they are sent on.
HELD = 4_000_000


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def tokens(texts: list[str]):
    """(first, last, hashes with an end token after each text, offsets)."""
    for first, last, h, offsets in word_hashes(texts):
        out = np.insert(h, offsets[1:], END)
        yield first, last, out, offsets + np.arange(len(offsets))


def _merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sorted keys with their columns added up."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] + 1 if len(keys) else 0)) if len(keys) else np.zeros(0, np.int64)
    if len(keys) and (not len(first) or first[0] != 0):
        first = np.insert(first, 0, 0)
    columns = [np.concatenate([p[i] for p in parts])[order] for i in range(1, len(parts[0]))]
    return [keys[first], *[np.add.reduceat(c, first) if len(first) else c for c in columns]]


def _counted(keys: np.ndarray) -> list[np.ndarray]:
    k, n = np.unique(keys, return_counts=True)
    return [k, n.astype(np.int64)]


def _cut(counts: list[np.ndarray], shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    for s, rows in zip(*_groups(shard[order], order), strict=True):
        yield int(s), pack(*[c[rows] for c in counts])


def _groups(sorted_keys: np.ndarray, values: np.ndarray):
    keys, at = np.unique(sorted_keys, return_index=True)
    return keys, np.split(values, at[1:]) if len(keys) else []


def _send(rows: list[tuple], names=("shard", "m")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


@dataclass
class Model:
    """Where the sorted arrays are, and the few numbers that smoothing needs."""

    folder: str
    shards: int
    sizes: list[int]
    tokens: int = 0
    discounts: list[list[float]] = field(default_factory=list)
    types: int = 0
    #: Words with one, two, and three or more different words before them.
    low: list[int] = field(default_factory=list)

    @property
    def words(self) -> int:
        return sum(self.sizes)

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        import os

        path = local_path(f"{self.folder}/{name}-{shard}")
        return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)


class Reader:
    """One worker's view of the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.base = np.concatenate([[0], np.cumsum(model.sizes)]).astype(np.int64)
        self.maps: dict[tuple[str, int, int], np.ndarray] = {}

    def map(self, name: str, shard: int, dtype) -> np.ndarray:
        key = name, shard, np.dtype(dtype).itemsize
        if key not in self.maps:
            self.maps[key] = self.model.array(name, shard, dtype)
        return self.maps[key]

    def _find(self, keys: np.ndarray, shard: np.ndarray, name: str) -> np.ndarray:
        """Places of sorted unique keys within their shard, -1 where absent."""
        out = np.full(len(keys), -1, np.int64)
        for s, rows in zip(*_groups(shard, np.arange(len(keys))), strict=True) if len(keys) else []:
            held = self.map(name, int(s), np.uint64)
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[rows]), len(held) - 1)
                out[rows] = np.where(held[at] == keys[rows], at, -1)
        return out

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted unique word hashes, -1 for unknown words."""
        shard = shard_of(h, self.model.shards)
        at = self._find(h, shard, "word")
        return np.where(at >= 0, self.base[shard] + at, -1)

    def of_ids(self, ids: np.ndarray, name: str, dtype) -> np.ndarray:
        """Values of sorted word numbers (none negative)."""
        shard = np.searchsorted(self.base, ids, "right") - 1
        width = 4 if name == "after" else 1
        out = np.zeros((len(ids), width), dtype)
        for s, rows in zip(*_groups(shard, np.arange(len(ids))), strict=True) if len(ids) else []:
            out[rows] = self.map(name, int(s), dtype).reshape(-1, width)[ids[rows] - self.base[int(s)]]
        return out if width > 1 else out[:, 0]

    def counts(self, shard: int) -> np.ndarray:
        """Counts of a shard's bigrams: 32 bits each, or 64 where one of them needs more."""
        pairs, small = self.map("pair", shard, np.uint64), self.map("count", shard, np.uint32)
        return small if len(small) == len(pairs) else self.map("count", shard, np.int64)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of unique bigrams (word number << 32 | word number)."""
        shard = shard_of(mix64(keys), self.model.shards)
        order = np.argsort(shard, kind="stable")
        at = np.empty(len(keys), np.int64)
        at[order] = self._find(keys[order], shard[order], "pair")
        out = np.zeros(len(keys), np.int64)
        for s, rows in zip(*_groups(shard[order], order), strict=True) if len(keys) else []:
            ok = rows[at[rows] >= 0]
            out[ok] = self.counts(int(s))[at[ok]]
        return out


def _discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of types seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def _of_counts(x: np.ndarray) -> list[int]:
    return [int((x == k).sum()) for k in (1, 2, 3, 4)]


def train(spark: SparkSession, docs: DataFrame, ws: Workspace) -> Model:
    """The model of all texts of ``docs(doc_id, text)``."""
    texts, shards, folder = text_or_empty(docs).select("text"), n_shards(spark), ws.mkdir("model")

    def send_words(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, h, _ in tokens(batch.column(0).to_pylist()):
                held.append(_counted(h))
                size += len(held[-1][0])
            if size > HELD:
                held = [_merge(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield _send(list(_cut(held[0], shard_of(held[0][0], shards))))
                    held, size = [], 0
        if held:
            merged = _merge(held)
            yield _send(list(_cut(merged, shard_of(merged[0], shards))))

    def merge_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = _merge([unpack(x) for x in pdf.m])
        write_file(f"{folder}/word-{key[0]}", h.tobytes())
        write_file(f"{folder}/seen-{key[0]}", n.astype("<i8").tobytes())
        return pd.DataFrame({"shard": [key[0]], "n": [len(h)], "total": [int(n.sum())]})

    found = texts.mapInArrow(send_words, "shard int, m binary").groupBy("shard").applyInPandas(merge_words, "shard int, n long, total long").collect()  # one row a shard
    sizes = [0] * shards
    for r in found:
        sizes[r.shard] = r.n
    model = Model(folder, shards, sizes, sum(r.total for r in found))
    if model.words >= 2**32 - 1:
        raise ValueError("more different words than 32-bit numbers")
    start = model.words  # the number of the start of a text

    def send_pairs(batches):
        reader, held, size = Reader(model), [], 0
        for batch in batches:
            for _, _, h, offsets in tokens(batch.column(0).to_pylist()):
                u, inverse = np.unique(h, return_inverse=True)
                ids = reader.word_ids(u)[inverse]
                before = np.empty(len(ids), np.int64)
                before[1:] = ids[:-1]
                before[offsets[:-1]] = start
                held.append(_counted((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)))
                size += len(held[-1][0])
            if size > HELD:
                merged = _merge(held)
                yield _send(list(_cut(merged, shard_of(mix64(merged[0]), shards))))
                held, size = [], 0
        if held:
            merged = _merge(held)
            yield _send(list(_cut(merged, shard_of(mix64(merged[0]), shards))))

    spans = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def merge_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merge([unpack(x) for x in pdf.m])
        write_file(f"{folder}/pair-{key[0]}", keys.tobytes())
        write_file(f"{folder}/count-{key[0]}", n.astype("<u4" if n.max(initial=0) < 2**32 else "<i8").tobytes())
        left, right, one = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.ones(len(keys), np.int64)
        after = _merge([[left, (n == 1) * one, (n == 2) * one, (n > 2) * one, n]])
        before = _merge([[right, one]])
        rows = [("of", -1, np.array(_of_counts(n), np.int64).tobytes())]
        for kind, columns in (("after", after), ("before", before)):
            shard = np.minimum(np.searchsorted(spans, columns[0], "right") - 1, shards)
            rows += [(kind, s, m) for s, m in _cut(columns, shard)]
        return pd.DataFrame(rows, columns=["kind", "shard", "m"])

    stats = texts.mapInArrow(send_pairs, "shard int, m binary").groupBy("shard").applyInPandas(merge_pairs, "kind string, shard int, m binary")
    stats = ws.save(stats, "stats")

    def merge_stats(key, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        merged = _merge([unpack(x) for x in pdf.m])
        n = sizes[shard] if shard < shards else 1
        out = np.zeros((n, len(merged) - 1), np.int64)
        out[merged[0] - spans[shard]] = np.stack(merged[1:], axis=1)
        write_file(f"{folder}/{kind}-{shard}", out.tobytes())
        return pd.DataFrame([(*_of_counts(out[:, 0]), int(out[:, 0].sum()))] if kind == "before" else [], columns=["n1", "n2", "n3", "n4", "types"])

    lower = stats.filter("kind != 'of'").groupBy("kind", "shard").applyInPandas(merge_stats, "n1 long, n2 long, n3 long, n4 long, types long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "types")]).first()
    upper = np.sum([np.frombuffer(r.m, np.int64) for r in stats.filter("kind = 'of'").select("m").collect()] or [[0] * 4], axis=0)  # one row a shard
    model.discounts, model.types = [_discounts(list(lower[:4])), _discounts(upper.tolist())], lower.types
    model.low = [lower.n1, lower.n2, model.words - lower.n1 - lower.n2]  # every word has something before it
    ws.drop("stats")
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Reader(model)

    def __call__(self, texts: list[str]):
        """n_tokens, n_known, base_score and score of each text."""
        m, out = self.model, []
        for _, _, h, offsets in tokens(texts):
            u, inverse = np.unique(h, return_inverse=True)
            ids_u = self.reader.word_ids(u)
            known = np.flatnonzero(ids_u >= 0)
            seen, before = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
            after = np.zeros((len(u) + 1, 4), np.int64)
            seen[known] = self.reader.of_ids(ids_u[known], "seen", np.int64)
            before[known] = self.reader.of_ids(ids_u[known], "before", np.int64)
            after[known] = self.reader.of_ids(ids_u[known], "after", np.int64)
            after[-1] = m_start(self.reader)
            ids = ids_u[inverse]
            left = np.empty(len(ids), np.int64)  # places in u, the last for the start
            left[1:] = inverse[:-1]
            left[offsets[:-1]] = len(u)
            left_ids = np.append(ids_u, m.words)[left]
            pairs, back = np.unique((np.maximum(left_ids, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(ids, 0).astype(np.uint64), return_inverse=True)
            n = np.where((ids >= 0) & (left_ids >= 0), self.reader.pair_counts(pairs)[back], 0)
            base = np.log10((seen + 1) / (m.tokens + m.words + 1))[inverse]
            p = np.log10(self.probability(n, after[left], before[inverse]))
            ends, starts = offsets[1:], offsets[:-1]
            out.append((ends - starts, np.add.reduceat((seen[inverse] > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(p, starts)))
        return [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(4)]

    def probability(self, n: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Interpolated: pairs over continuations over the uniform over all words and one unknown."""
        m = self.model
        if not m.types:
            return np.ones(len(n))
        d1, d2 = np.array([0, *m.discounts[0]]), np.array([0, *m.discounts[1]])
        low_mass = (d1[1] * m.low[0] + d1[2] * m.low[1] + d1[3] * m.low[2]) / m.types
        low = np.maximum(before - d1[np.minimum(before, 3)], 0) / m.types + low_mass / (m.words + 1)
        total = after[:, 3]
        mass = (d2[1] * after[:, 0] + d2[2] * after[:, 1] + d2[3] * after[:, 2]) / np.maximum(1, total)
        high = np.maximum(n - d2[np.minimum(n, 3)], 0) / np.maximum(1, total)
        return np.where(total > 0, high + mass * low, low)


def m_start(reader: Reader) -> np.ndarray:
    x = reader.map("after", reader.model.shards, np.int64)
    return x[:4] if len(x) else np.zeros(4, np.int64)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every text."""

    def apply(batches):
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                n, known, base, p = scorer(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(p), pa.array(10 ** (-p / n))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return text_or_empty(docs).mapInArrow(apply, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(spark, docs.filter(~F.coalesce(held_out(), F.lit(False))), Workspace(spark, "op4"))
    scored = score(spark, docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
