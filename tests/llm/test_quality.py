"""Operator 3: held-out accuracy and edge cases."""

import numpy as np

from lumenreel.llm import quality


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op3_random_indexing_quality(spark, sf).collect()}
    assert len(got) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in got}
    out = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = np.array([s for s, y in out if y]), np.array([s for s, y in out if not y])
    assert (good[:, None] > bad[None, :]).mean() > 0.93
    assert np.mean([(s >= 0.5) == bool(y) for s, y in out]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "a b", 3), (3, "a b", 3), (None, "c", 3), (4, "x " * 100000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (99, 1)], "doc_id long, quality int")
    rows = quality.score(spark, docs, *quality.fit(spark, docs, labels)).collect()
    assert len(rows) == 6 and all(r.score == 0.5 for r in rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    rows = quality.score(spark, docs, *quality.fit(spark, docs, labels)).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    none = docs.filter("doc_id > 50")
    assert quality.score(spark, none, *quality.fit(spark, none, labels)).count() == 0


def test_the_bound_holds_for_rows_that_share_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"word {i}", 1) for i in range(300)], "doc_id long, text string, x int")
    seen = []
    real = quality.Network.__init__
    monkeypatch.setattr(quality.Network, "__init__", lambda self, x, y: (seen.append(len(x)), real(self, x, y))[1])
    labels = spark.createDataFrame([(0, 1), (0, 0)], "doc_id long, quality int")
    quality.fit(spark, docs, labels, 50)
    assert seen == [50]


def test_temperature_keeps_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    net = quality.Network(x, y)
    assert np.all(np.diff(net(x)[np.argsort(net.logits(x))]) >= 0)
    assert np.mean((net(x) > 0.5) == y) > 0.8
