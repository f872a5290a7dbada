"""Operator 10 against a dictionary of windows; its parts against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from lumenreel.llm import suffixes
from lumenreel.llm.common import Workspace


def brute(rows, length=100):
    seen, out = set(), []
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", b"m") for i, t in rows], "doc_id long, text string, uid int, doc string, m binary")
    got = suffixes.without_repeats(spark, docs.repartition(5), Workspace(spark, "t"), **options)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)


def test_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, suffixes.op10_suffix_array_dedup(spark, sf).collect()), key=repr) == brute(rows)


def texts(rng, n, alphabet, passages):
    word = lambda: "".join(rng.choices(alphabet, k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(passages)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(60, 200)], " ".join(word() for _ in range(rng.randint(0, 10)))]
        out.append((i, " ".join(parts)))
    return out


def test_passages(spark):
    rows = texts(random.Random(4), 150, "abcdéü", 5)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("part", [500, 3000, 1 << 21])
def test_parts_are_merged(part):
    contents = [t.encode() for _, t in texts(random.Random(6), 60, "ab", 4)]
    contents = [c for c in contents if len(c) >= 100]
    base = np.cumsum([0, *[len(c) - 99 for c in contents]])
    seen, want = set(), []
    for c, at in zip(contents, base.tolist(), strict=False):
        for s in range(len(c) - 99):
            if c[s : s + 100] in seen:
                want.append(at + s)
            seen.add(c[s : s + 100])
    got = suffixes.later_windows(contents, [np.arange(a, b) for a, b in zip(base[:-1], base[1:], strict=True)], 100, part)
    assert sorted(got.tolist()) == want and want


def test_strings_longer_than_a_byte_counts(spark):
    shared = "".join(random.Random(5).choices("abc d", k=700))
    rows = [(1, "x" + shared), (2, shared + "y"), (3, "z" + shared[:400]), (4, shared[:299])]
    got = run(spark, rows, length=300)
    assert got == brute(rows, 300) and [r[2] for r in got] == [0, 700, 400, 0]


def test_edges(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=30000))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 101), (6, "ab" * 4000), (7, "b" + "ab" * 200), (8, long), (9, "_" + long[500:9000] + "~" + long[:120]), (10, "\0" * 300), (11, "é" * 120), (12, "\0" * 150 + "y")]
    assert run(spark, rows) == brute(rows)
    # Rows that share an id or have none: the same bytes stay in all.
    again = run(spark, [(4, long), (4, long), (None, long), (None, long[:200])])
    assert sorted(r[2] for r in again) == [0, 200, 30000, 30000] and next(r for r in again if not r[2])[0] == 4
    assert run(spark, []) == []


@pytest.mark.parametrize("alphabet", [b"ab", b"\0a", b"abcdefgh", b"a"])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(1)
    for n in (1, 2, 7, 8, 9, 30, 400):
        b = bytes(rng.choices(alphabet, k=n))
        a = np.frombuffer(b, np.uint8)
        order = suffixes.suffix_array(a)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        want = [0]
        for x, y in zip(order[:-1], order[1:], strict=True):
            k = 0
            while max(x, y) + k < n and b[x + k] == b[y + k]:
                k += 1
            want.append(min(k, 255))
        assert suffixes.common_prefixes(a, order, 255, lane=16).tolist() == want
