"""The pipeline's stages on small tables, each held against a plain version of its decisions."""

import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from lumenreel.llm import mixing, pii, quality
from lumenreel.llm.common import Workspace
from tests.llm.test_tokens import library_ids

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_and_duplicates(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(spark, docs, *quality.fit(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    good = rows(stages[0])
    assert set(good) == {i for i, s in scores.items() if s >= 0.5} and 0 < len(good) < len(scores)
    assert stages[0].columns == stages[1].columns == docs.columns

    def shingles(t):
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}

    left, sets = rows(stages[1]), {i: shingles(r.text) for i, r in good.items()}
    near = lambda a, b: len(a & b) * 100 >= 80 * len(a | b)
    ids = sorted(good)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and near(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert set(left) == {find(i) for i in ids} and len(left) < len(good)


def test_redaction_and_mix(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert set(before) == set(after) and stages[2].columns == stages[1].columns
    for i, r in after.items():
        spans = pii.base_spans(before[i].text)
        assert (r.text == before[i].text) == (not spans)
        assert r.n_chars == len(r.text)
    mixed = stages[3].collect()
    assert stages[3].columns == stages[2].columns
    size = lambda t: len(re.findall(WORD, t))
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + size(r.text)
        assert set(r.text.split()) <= set(after[r.doc_id].text.split())
    assert all(n <= 3 * size(after[i].text) for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size(r.text) for r in after.values())) <= 20


def test_packing(spark, stages):
    ids, docs = library_ids(), stages[3].collect()
    packed = stages[4].collect()
    assert sum(r.length for r in packed) == sum(len(ids(r.text)) for r in docs)
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_edges(spark, sf):
    rows_ = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "same words here and there again and again", "en", "s", 1), (2, "same words here and there again and again", "en", "s", 1), (3, "Same words here and there again and again", "en", "t", 1), (None, "same words here", None, "t", 2), (5, "w " * 30000, "en", None, 60000)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id > 99"), sf).count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "5", "None"]
    assert corpus_pipeline.redact_pii(spark, docs, sf).count() == len(rows_)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    assert {r.doc_id for r in mixed} == {2, 3, 5, None} or {r.doc_id for r in mixed} == {2, 3, 5}
    assert corpus_pipeline.pack_sequences(spark, docs, sf).count() == len(rows_) - 1 + -(-(len(library_ids()("w " * 30000))) // 1024)


def test_other_columns_stay(spark, sf):
    """Extra columns, with names that operators use themselves, go through all stages but the last as they are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id % 5 = 0")
    extra = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("score", "found", "words", "blocks", "epoch", "d", "s", "c", "uid", "copy", "size", "shard", "position", "node", "component_id", "n", "occ", "kind", "value", "target", "length", "ids")}
    docs = docs.withColumns(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.count() and set(extra) < set(docs.columns)
        assert not docs.filter(" or ".join(f"{c} != concat('{c}', doc_id)" for c in extra)).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_rows_lie_by_shard(spark, sf, monkeypatch):
    """Within each partition the mix stage's rows stand by shard and place of their first block."""
    monkeypatch.setattr(mixing.mix_blocks, "__defaults__", (2000, mixing.SEED))
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("n_chars", F.col("doc_id"))
    mixed = mixing.mixed_documents(spark, docs.drop("n_chars"), Workspace(spark, "t")).select("doc_id", F.spark_partition_id().alias("p")).collect()
    first = {}
    for r in sorted(mixing.mixed(spark, docs, Workspace(spark, "t"))[2].collect(), key=lambda r: -r.first_word):
        first[r.doc_id, r.epoch] = (r.shard, r.position)
    places = {}
    for (doc_id, _), place in first.items():
        places.setdefault(doc_id, set()).add(place)
    assert len(mixed) == len(first) and len({s for s, _ in first.values()}) > 3
    homes = {}
    for p in {r.p for r in mixed}:
        at = (-1, -1)
        for r in (r for r in mixed if r.p == p):
            at = min(x for x in places[r.doc_id] if x > at)  # the order goes on
            places[r.doc_id].remove(at)
            assert homes.setdefault(at[0], p) == p
