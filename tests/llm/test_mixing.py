"""Operator 8: targets and words against SQL, quotas of the tree, edge cases."""

import collections

import pytest
from pyspark.sql import functions as F

from lumenreel.llm import mixing
from lumenreel.llm.common import Workspace
from tests.llm import oracle


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, sf):
    got, want = oracle.rows_of(mixing.op8_hypergeometric_mix(spark, sf)), oracle.run(mixing.ORACLE, sf)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


def test_mix_takes_the_target(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ws = Workspace(spark, "t")
    rows, per, _ = mixing.mixed(spark, docs, ws)
    blocks = mixing.mix_blocks(spark, rows, per, Workspace(spark, "t"), shard_words=5000).collect()
    taken = collections.Counter()
    for b in blocks:
        taken[b.source] += b.n_words
    for s in per.collect():
        assert abs(taken[s.source] - s.target) <= 0.5
    shards = collections.Counter(b.shard for b in blocks)
    assert len(shards) > 5 and max(shards.values()) - min(shards.values()) <= 12
    assert len({(b.doc_id, b.copy, b.block, b.epoch) for b in blocks}) == len(blocks)
    for s, n in shards.items():
        assert sorted(b.position for b in blocks if b.shard == s) == list(range(n))


def test_tree_keeps_quotas(spark):
    q = [(0, 100000), (1, 7), (2, 0), (3, 2500)]
    tree = mixing.splitting_tree(spark.createDataFrame(q, "sid int, quota long"), 7).collect()
    by = collections.defaultdict(int)
    for r in tree:
        assert r.quota >= 0
        by[r.sid] += r.quota
    assert dict(by) == dict(q)
    big = [r.quota for r in tree if r.sid == 0]
    assert max(big) - min(big) < 400 and len(set(big)) > 1


def test_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "w " * 3000, "y"), (5, "a b", "z"), (5, "a b", "z"), (6, "  ", "only spaces"), (None, "q r", "y")]
    docs = spark.createDataFrame([(i, t, s, 7, 1.0, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, target double, key string")
    got = mixing.taken_words(spark, docs, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(r["size"] for r in got) == 3 + 3000 + 4 + 2
    assert abs(sum(r.taken for r in got) - sum({r.source: r.target for r in got}.values())) <= 2
    assert mixing.taken_words(spark, docs.filter("doc_id > 99"), Workspace(spark, "t")).count() == 0
    again = mixing.taken_words(spark, docs.withColumn("n", F.lit(1)).repartition(3), Workspace(spark, "t")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
