"""Operator 4 against a plain dictionary version."""

import collections
import math
import re
import zlib

import pytest

from lumenreel.llm import kneserney
from lumenreel.llm.common import Workspace


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]


def brute(rows, train):
    seen, pairs = collections.Counter(), collections.Counter()
    for _, t in train:
        w = words(t)
        seen.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(seen.values()), len(seen)
    before, after = collections.Counter(b for _, b in pairs), collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        after[a][min(c, 3) - 1] += 1
        after[a][3] += c
    of = lambda x: [sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]
    d1, d2 = [0, *kneserney._discounts(of(before))], [0, *kneserney._discounts(of(pairs))]
    types = len(pairs)
    low_mass = sum(d1[min(c, 3)] for c in before.values()) / max(1, types)
    out = {}
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)
        p = 0
        for a, b in zip(["<s>", *w], w):
            low = max(before[b] - d1[min(before[b], 3)], 0) / types + low_mass / (v + 1)
            if a in after:
                x = after[a]
                c = pairs[a, b]
                p += math.log10(max(c - d2[min(c, 3)], 0) / x[3] + (d2[1] * x[0] + d2[2] * x[1] + d2[3] * x[2]) / x[3] * low)
            else:
                p += math.log10(low)
        out[i] = (len(w), sum(seen[x] > 0 for x in w), base, p)
    return out, n


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want, n = brute(rows, [r for r in rows if not out(r[0])])
    got = kneserney.op4_kneser_ney(spark, sf).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {n}
    for r in got:
        assert r.held_out == out(r.doc_id)
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][2:])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb c É é"), (4, "a " * 50000), (4, "a b"), (None, "a b"), (5, " x ")]
    docs = spark.createDataFrame([(i, t, 9, 0.5) for i, t in rows], "doc_id long, text string, shard int, score double")
    model = kneserney.train(spark, docs, Workspace(spark, "t"))
    want, n = brute(list(enumerate(t for _, t in rows)), rows)
    got = kneserney.score(spark, docs, model).collect()
    assert model.tokens == n
    assert sorted(round(r.score, 6) for r in got) == sorted(round(x[3], 6) for x in want.values())
    none = docs.filter("doc_id > 50")
    empty = kneserney.train(spark, none, Workspace(spark, "t"))
    assert kneserney.score(spark, none, empty).count() == 0
    assert [r.score for r in kneserney.score(spark, docs.limit(1), empty).collect()] == [0.0]
