import hashlib
import math
import random
import re
import zlib

import numpy as np

from lumenreel.llm import resampling
from lumenreel.llm.common import Workspace
from lumenreel.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.oracle import rows_of, run_exact

SCHEMA = "doc_id long, text string"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000), np.zeros(10000)
    for rows, into in ((docs, s), (target, t)):
        for _, text in rows:
            for f in features(text)[1]:
                into[bucket(f)] += 1
    below, above = s.sum() + 10000, t.sum() + 10000
    gain = [math.floor(1000 * math.log((t[i] + 1) * below / ((s[i] + 1) * above))) for i in range(10000)]
    out = []
    for d, text in docs:
        words, fs = features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * 25 // 100])}
    return sorted(((d, n, ranks.get(id(r)), score, weight) for r in out for d, n, weight, score, _ in [r]), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "9", "ß", "中文", "the", "of"]
    signs = [" ", "  ", "-", "\n", "_", "\x7f", ", ", " "]
    return [(i, "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_against_plain(spark):
    docs, target = made(3, 120), made(4, 10)
    docs += [(200, None), (201, ""), (202, "-- !"), (None, "the of " * 15), (7, docs[7][1]), (203, "word " * 30000)]
    found = resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(target, SCHEMA), Workspace(spark, "t"))
    assert rows_of(found) == plain(docs, target)


def test_stretches_meet(monkeypatch):
    raw = " ".join(f"w{i % 37}" for i in range(500)).encode()
    whole = np.concatenate([f for _, f in resampling.feature_buckets(raw, 3, 10000)])
    monkeypatch.setattr(resampling, "STRETCH", 11)
    parts = np.concatenate([f for _, f in resampling.feature_buckets(raw, 3, 10000)])
    assert len(whole) == 500 + 499 + 498
    assert (np.sort(whole) == np.sort(parts)).all()
    assert sum(n for n, _ in resampling.feature_buckets(raw, 3, 10000)) == 500


def test_empty_tables_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(empty, empty, Workspace(spark, "t")).collect() == []
    wide = spark.createDataFrame([(1, "a b", 5, 6)], SCHEMA + ", weight long, at long")
    row = resampling.resample(wide, empty, Workspace(spark, "t")).first()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 3, None)


def test_query(spark, sf):
    assert rows_of(QUERIES["op12_importance_resampling"](spark, sf)) == run_exact(ORACLE_SQL["op12_importance_resampling"], sf)
