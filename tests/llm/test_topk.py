"""Operator 7 against brute force."""

import math

import numpy as np
import pytest

from lumenreel.llm import topk
from lumenreel.llm.common import Workspace
from tests.llm import oracle


def brute(rows, every, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, every=20, k=20):
    df = topk.integers(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, q int, c int"))
    return sorted(map(tuple, topk.exact_top_k(spark, df.filter(df.vec_id % every == 0), df, Workspace(spark, "t"), k).collect()))


def test_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.op7_histogram_top_k(spark, sf).collect())) == brute(rows, 20, 20)
    assert oracle.rows_of(topk.op7_histogram_top_k(spark, sf)) == oracle.run(topk.ORACLE, sf)


def test_blocks_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "ROW_BLOCK", 30)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(120, 220)]
    rows += [(220, None), (240, [None, 1.0, 1.0, 1.0]), (260, [math.nan, 1.0, 1.0, 1.0]), (280, [math.inf, 0.0, 0.0, 0.0]), (300, [0.0] * 4), (320, [1.0]), (340, [1.0, 2.0]), (341, [3000.0, 2.0])]
    assert run(spark, rows, 20, 5) == brute(rows, 20, 5)


def test_empty_and_few(spark):
    assert run(spark, []) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 0.0])]
    assert run(spark, rows) == brute(rows, 20, 20)


def test_rows_that_share_an_id_and_large_components(spark):
    """Different rows of one id are queries of their own, equal ones one query."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    got = run(spark, rows, 20, 2)
    assert got == sorted([(0, 1, 1, 64 * 64 * 5), (0, 2, 3, 64 * 64), (0, 1, 2, 64 * 64 * 3), (0, 2, 3, 64 * 64)])
    with pytest.raises(ValueError, match="64-bit"):
        run(spark, [(0, [1e18, 0.0]), (1, [1e18, 1.0])])


def test_scores_beyond_the_doubles(spark):
    """Scores of 2^60 and more that differ by one."""
    rows = [(0, [2.0**24, 1 / 64])] + [(i, [2.0**24, i / 64]) for i in range(1, 101)]
    got = run(spark, rows, 1000, 20)
    assert got == brute(rows, 1000, 20)
    assert [r[2] for r in got[:3]] == [100, 99, 98]
    rows = [(i, [-(2.0**24), i / 64]) for i in range(60)] + [(60, [2.0**24, 5.0])]
    assert run(spark, rows, 20, 3) == brute(rows, 20, 3)
