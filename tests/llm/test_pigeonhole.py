"""Operator 2 against brute force."""

import math

import numpy as np
import pytest

from lumenreel.llm import pigeonhole
from lumenreel.llm.common import Workspace
from tests.llm import oracle


def brute(rows, cosine=0.95):
    ok = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in ok.items():
        for j, b in ok.items():
            if j < i and len(a) == len(b) and rows[i][0] != rows[j][0] and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, n, least.get(find(i))) for i, ((d, _), n) in enumerate(zip(rows, links, strict=True))), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in pigeonhole.near_duplicates(spark, df, Workspace(spark, "t"), **options).collect()), key=repr)


def test_table(spark, sf):
    got = oracle.rows_of(pigeonhole.op2_subspace_pigeonhole(spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == sorted(((c, c == d, n, d) for d, n, c in brute(rows)), key=repr)
    assert got == oracle.run(pigeonhole.ORACLE, sf)


@pytest.mark.parametrize(("dim", "cosine", "blocks"), [(16, 0.95, 4), (6, 0.8, 4), (3, 0.99, 2)])
def test_clusters_split_into_pieces(spark, dim, cosine, blocks):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    v = np.concatenate([c + rng.normal(size=(40, dim)) * s for c, s in zip(centres, (0.05, 0.1, 0.15, 0.2, 0.3, 1.0), strict=True)]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert run(spark, rows, cosine=cosine, blocks=blocks, piece=16) == brute(rows, cosine)


def test_edges(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, same), (4, same), (9, same), (3, [2.0, 4.0, 6.0, 8.0]), (2, [-1.0, -2.0, -3.0, -4.0]), (1, None), (0, []), (6, [0.0] * 4), (7, [None, 1.0, 1.0, 1.0]), (8, [math.nan, 1.0, 1.0, 1.0]), (10, [math.inf, 0.0, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [1.0]), (13, [2.0]), (None, same)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, same), (1, same), (2, [1.0, 2.0, 3.0, 4.5])])[0][2] == 1


def test_lengths_beyond_the_range_of_squares(spark):
    """Only null, zero and non-finite vectors link with nothing."""
    base = np.random.default_rng(1).normal(size=(4, 8))
    rows = [(10 * i + k, (base[i] * scale).tolist()) for i in range(4) for k, scale in enumerate((1.0, 1e-170, 1e160, 3.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pigeonhole.near_duplicates(spark, df, Workspace(spark, "t")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((10 * i + k, 3, 10 * i) for i in range(4) for k in range(4))


def test_decisions_do_not_depend_on_company():
    """Distances by which pairs on an edge are decided are the same in pieces of any size, and from either side."""
    rng = np.random.default_rng(2)
    sub = pigeonhole.Subspaces(16, 0.95, 4)
    x, x2 = rng.normal(size=(600, 16)), rng.normal(size=(600, 16))
    for k in range(4):
        whole = sub.apart(x, x2, k)
        assert (whole == sub.apart(x2, x, k)).all()
        for rows in (slice(0, 1), slice(3, 40), slice(100, 333)):
            assert (sub.apart(x[rows], x2[rows], k) == whole[rows]).all()
        lo, hi = sub.edges[k], sub.edges[k + 1]
        assert np.allclose(whole, ((sub.rotate(x)[:, lo:hi] - sub.rotate(x2)[:, lo:hi]) ** 2).sum(axis=1))


def shuffled(spark) -> int:
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))


def test_vectors_are_not_sent_to_their_meetings(spark):
    """What is shuffled follows the vectors, not the meetings of their pieces: disk ended the run on large tables."""
    v = np.random.default_rng(7).normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3).localCheckpoint()
    before = shuffled(spark)
    assert pigeonhole.near_duplicates(spark, df, Workspace(spark, "t"), piece=512).filter("n_links > 0").count() == 0
    assert shuffled(spark) - before < 6 * v.nbytes


def test_a_shared_id_counts_each_link_once(spark):
    """Two vectors of one id keep counts of their own."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    got = run(spark, [(1, a), (1, b), (2, [1.0, 0.01, 0.0, 0.0]), (3, [0.0, 0.01, 1.0, 0.0])])
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1)]
