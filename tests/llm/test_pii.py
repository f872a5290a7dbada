"""Operator 1: base spans against plain regular expressions, contexts learned from seeds, edge cases."""

import hashlib
import random
import re
import sys
import time

from pyspark.sql import functions as F

from lumenreel.llm import pii
from lumenreel.llm.common import Workspace


sys.set_int_max_str_digits(0)


def plain(text):
    """As the contract states it, form by form."""
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.FORMS[kind], text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                odd = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1]))
                if not 12 <= len(digits) <= 19 or odd % 10:
                    continue
            out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


TEXTS = ["é a.b@c.de, x@y 1.2.3.4.5 300.1.1.1 001.02.3.255", "+1 (743) 555-3824 +12 +123456789012345678", "card 4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "a@b.c@d.e..f@g.h", "１２３.1.1.1 1.1.1.１", "+1 4111111111111111 9.9.9.9-", "0" * 6000 + ".1.1.1", "1" * 30 + "2.3.4.5.6.7.8.9", "a@b@c.d@e.f.@g.h x.@y.z", "..@..a@-.-", "1.2.3.4" * 9, "", None, "x" * 50000 + " 10.0.0.1"]


def test_base(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.op1_bootstrapped_pii(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in [*rows]:
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]
    for t in TEXTS:
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in pii.base_spans(t or "")) == plain(t)


def test_forms_on_strings_of_their_own_signs():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("aé@@..--_%+ ()019") for _ in range(rng.randint(0, 24)))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in pii.base_spans(t)) == plain(t), t


def test_long_runs_take_linear_time():
    for unit in ("7", "a", ".", "-", "@", "a@", "1.", "+1", "(", "a1-", "x_", "é", " 1", "a.b ", "at dot "):
        start = time.perf_counter()
        text = unit * (1_000_000 // len(unit))
        base = pii.base_spans(text)
        around = pii.Contexts(text)
        for s, e in pii.other_values(text, base)[:1000]:
            around(s, e)
        assert time.perf_counter() - start < 8, unit


def test_values_of_several_words_and_whole_contexts():
    text = "call me on (743) 555-3824 now; ann at example dot com, or j.doe_home, not 12 or 13"
    assert [text[s:e] for s, e in pii.other_values(text, [])] == ["743) 555-3824", "ann at example dot com", "j.doe_home", "12", "13"]
    a, b = "x" * 120 + "a", "x" * 120 + "b"
    one, other = (pii.Contexts(f"{w} {w} 5b {w}")(245, 247) for w in (a, b))
    assert len(one) == 2 and not set(one) & set(other)


def test_values_at_home_elsewhere_are_turned_down(spark):
    """A chain of patterns longer than a few rounds is followed to its end; a common value is no identifier."""
    rows = [f"reach start now +1 (743) 55{i:03d}-3824 enda" for i in range(330)]
    pools = [[f"id{k}x{i}q" for i in range(n)] for k, n in enumerate((80, 19, 4, 1))]
    for k, pool in enumerate(pools):  # four of five values of each context are known from the one before
        before = "reach start now" if not k else f"link{'abc'[k - 1]} via{'abc'[k - 1]} as{'abc'[k - 1]}"
        rows += [f"{before} {v} end{'abcd'[k]}" for v in [*(pools[k - 1] if k else []), *pool]]
    rows += ["reach start now v2 enda"] + [f"w{c} version{c} v2 of{c} it" for c in "abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs, Workspace(spark, "t")).withColumn("spans", pii.spans_text()).collect()}
    for i, t in enumerate(rows):
        if re.search(r"id\dx", t):
            assert got[i].n_found == 1 and got[i].spans.startswith("phone:"), t
        if "v2" in t:
            assert got[i].n_found == 0, t


def test_contexts_find_what_no_form_matches(spark):
    rows = [(i, f"word {i}x and then call me on +1 (743) 555-38{i:02d} today or else") for i in range(12)]
    rows += [(100, "please call me on ext.5538-99 today"), (101, "room 5538b is not a phone"), (102, None), (102, ""), (102, "seen twice"), (None, "call me on 77-20-x today")]
    docs = spark.createDataFrame([(i, t, "s", 3, 1) for i, t in rows], "doc_id long, text string, kind string, n_chars long, value int").withColumn("found", F.lit(1)).withColumn("uid", F.lit("u"))
    got = pii.find(docs, Workspace(spark, "t")).withColumn("spans", pii.spans_text()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].spans == "phone:18:29" and by[100].n_phone == 0 and by[100].n_found == 1
    assert by[101].spans == "" and by[None].spans == "phone:11:18"
    clean = pii.redact(docs, Workspace(spark, "t")).collect()
    assert len(clean) == len(rows) and {r.text for r in clean if r.doc_id in (100, 101)} == {"please call me on <phone> today", "room 5538b is not a phone"}
    assert all(r.n_chars == len(r.text) for r in clean if r.doc_id in range(12)) and all(r.kind == "s" for r in clean)
    assert pii.find(docs.filter("doc_id > 999"), Workspace(spark, "t")).count() == 0
    assert pii.redact(docs.filter("doc_id > 999"), Workspace(spark, "t")).count() == 0
