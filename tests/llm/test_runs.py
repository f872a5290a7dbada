"""Words that differ have different hashes, also those for which polynomials modulo powers of two agree."""

import numpy as np

from lumenreel.llm import partenum, runs
from lumenreel.llm.common import Workspace


def thue_morse(bits):
    bits = [bin(i).count("1") % 2 for i in range(1 << bits)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(text):
    return np.concatenate([h for _, _, h, _ in runs.word_hashes([text])])


def test_complementary_words():
    for bits in range(3, 14):
        a, b = hashes(" ".join(thue_morse(bits))).tolist()
        assert a != b
    long = "x" * 5000
    one, two, three = hashes(f"{long} {long.upper()} {long}y").tolist()
    assert one == two != three


def test_sets_of_such_words_are_not_linked(spark):
    a, b = thue_morse(11)
    df = spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")
    got = partenum.jaccard_classes(spark, df, Workspace(spark, "t"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_such_words_are_different_tokens():
    a, b = thue_morse(11)
    assert len(set(hashes(f"{a} {b} {a}").tolist())) == 2


def test_rows_without_ids_meet_by_their_texts(spark):
    """Ten thousand near copies without an id: each wanted set loads one text, not all of them."""
    words = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(words[:100] + [f"x{i}"])) for i in range(10_000)] + [(5, " ".join(words[:100])), (6, "other words that stand alone"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = partenum.jaccard_classes(spark, df, Workspace(spark, "t")).groupBy("doc_id", "component_id").count().collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r["count"]) for r in got) == [(0, 0, 1), (0, 5, 10_000), (5, 5, 1), (6, 6, 1)]
