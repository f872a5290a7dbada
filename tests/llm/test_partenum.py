"""Operator 9 against brute force."""

import random
import re

from lumenreel.llm import partenum
from lumenreel.llm.common import Workspace
from tests.llm import oracle


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if rows[i][0] == rows[j][0] is not None or a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", b"m") for i, t in rows], "doc_id long, text string, node int, shard string, m binary")
    got = partenum.jaccard_classes(spark, docs.repartition(3), Workspace(spark, "t"))
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.op9_partenum_jaccard(spark, sf).collect()), key=repr)
    assert got == brute(rows)
    assert sorted(((d, n, c) for c, d, n in oracle.run(partenum.ORACLE, sf)), key=repr) == got


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 if rng.random() < share else w for w in words]


def test_chains_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HELD", 5000)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(300)]
    rows = []
    for size in (5, 9, 14, 25, 40, 60, 120, 300):
        for _ in range(4):
            words = rng.choices(vocabulary, k=size)
            for _ in range(12):  # a chain of copies, each of the one before
                words = edited(rng, words, rng.choice([0, 0.01, 0.02, 0.04]))
                cut = rng.choice([0, 0, 1, size // 12])
                rows.append((len(rows), " ".join(words[cut:])))
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(3, 12)))) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    long = "w%d " * 3000 % tuple(range(3000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "One"), (7, "one "), (6, "one two three"), (8, "ONE\ttwo\x0bthree"), (2, long), (12, long + "end"), (12, "x"), (11, "x"), (None, "one"), (None, "lonely words"), (10, "é É"), (13, "é É"), (13, "é É")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_no_pair_is_lost_by_signatures():
    import numpy as np

    rng, bands = np.random.default_rng(1), partenum.Bands()
    for _ in range(400):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 1 << 48, n + 40, dtype=np.uint64)
        a, b = base[: n], base[int(rng.integers(0, max(1, n // 12) + 1)) : n + int(rng.integers(0, 3))]
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        sig, of = bands.signatures([a, b])
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
        assert np.bitwise_count(partenum.sketch(a) ^ partenum.sketch(b)).sum() <= len(np.setxor1d(a, b))


def test_long_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (3, 100, 900, 5000):
        base = rng.integers(0, 1 << 48, 2 * n, dtype=np.uint64)
        a, b = base[:n], base[n // 10 : n + n // 3]
        bits = partenum.sketches_differ(partenum.long_sketch(a, 85, 100), partenum.long_sketch(b, 85, 100))
        assert n // 20 <= bits <= len(np.setxor1d(a, b))
