import random
import re
import zlib
from collections import Counter

from lumenreel.llm import spelling
from lumenreel.llm.common import Workspace
from lumenreel.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.oracle import rows_of, run_exact


def near(a, b):
    """Whether one letter inserted, deleted or replaced leads from one to the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def plain(counts, ratio=2):
    out, form = [], {}
    for w in counts:
        others = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        best = others[0] if others and counts[others[0]] >= ratio * counts[w] else None
        form[w] = best
        out.append([w, best, len(others)])
    rows = []
    for w, best, n in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((best, counts[best] if best else None, counts[w], n, root, w))
    return sorted(rows, key=repr)


def found(spark, counts, ratio=2):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return rows_of(spelling.spelling_variants(df, Workspace(spark, "t"), ratio))


def made(seed, n, letters):
    rng, counts = random.Random(seed), {}
    while len(counts) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
        for _ in range(rng.randint(1, 3)):
            counts[w] = rng.choice([3, 3, 5, 6, 7, 12, 14, 30, 100])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]) or "a"
    return counts


def test_against_plain(spark):
    for seed, letters in ((1, "ab"), (2, "abcé"), (3, "aß中😀")):
        counts = made(seed, 150, letters)
        assert found(spark, counts) == plain(counts)
    counts = made(4, 150, "abc")
    assert found(spark, counts, 3) == plain(counts, 3)


def test_anagrams_alone_are_not_near(spark):
    counts = {"listen": 5, "silent": 50, "enlist": 500, "listens": 7, "lissen": 3}
    assert found(spark, counts) == plain(counts)
    assert {r[5]: r[0] for r in found(spark, counts)}["silent"] is None


def test_long_words_and_long_chains(spark):
    counts = {"x" * 20000 + "y": 3, "x" * 20000: 9, "x" * 20001: 30}
    counts |= {"k" * (10 + i): 3 * 2**i for i in range(30)}
    assert found(spark, counts) == plain(counts)


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), Workspace(spark, "t")).collect() == []


def test_words_of_documents(spark):
    rng = random.Random(9)
    words = ["Winter", "wintér", "ÀÉÎõü", "abc", "Straße", "Ünter", "naïveté", "summer", "sumer"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "1", "-", "\n"]) for _ in range(200))) for i in range(60)] + [(60, None), (None, "summer " * 9), (3, "winter"), (3, "winter")]
    counts = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    assert rows_of(spelling.count_words(spelling.misspelled(spelling.runs_of(df)))) == sorted(((n, w) for w, n in counts.items()), key=repr)


def test_query(spark, sf):
    assert rows_of(QUERIES["op11_anagram_variants"](spark, sf)) == run_exact(ORACLE_SQL["op11_anagram_variants"], sf)


def test_words_are_not_broadcast(spark):
    """No table of words goes through the driver, whatever size its files suggest."""
    plans = []

    class Recording(Workspace):
        def save(self, df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, name)

    ws = Recording(spark, "t")
    words = spark.createDataFrame([("abcde", 40), ("abcdf", 20), ("abcdfg", 10), ("zzzzz", 3)], "word string, n long")
    got = spelling.spelling_variants(words, ws)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {r.word: r.root for r in got.collect()} == {"abcde": "abcde", "abcdf": "abcde", "abcdfg": "abcde", "zzzzz": "zzzzz"}
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
