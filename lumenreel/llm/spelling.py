"""Operator 11: spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each of its letters, so words of the
same letters share a key, and one letter added, removed or exchanged changes it by
that letter's value, or by the difference of two. Two words one letter apart
therefore share a key once the differing letters' values are taken off: a word
meets longer ones by its own key, and words of its length by keys less one letter.
A single edit leaves one half of a word as it stands, in place; that half belongs
to what is joined, so that only candidates with part of their letters in order
meet, and no list of anagrams meets itself. The order of all letters is verified
on the words. Keys are those of distinct words: a word is counted first, and it has
at most as many keys as it has different letters, however long it is.

Each word then takes its most frequent near word as its form where that is at least
``ratio`` times as frequent, and forms are followed to the last one by doubling
steps; as counts grow by ``ratio`` on the way, a bound on the steps is known.

Edge cases: null texts hold no words; a row without a doc_id counts as one whose id
is the empty string; texts and words of any length are read whole; words of equal
counts are chosen between by code points; repeated rows count again; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, table

#: Letters of words, as a character class, once A to Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Keys are sums modulo this prime, so that no word is too long for them.
MODULUS = (1 << 61) - 1


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def letter_value(letter: Column) -> Column:
    """Fifth power of the code point (of its last twelve bits, which are all of it in the alphabets used here)."""
    x = F.ascii(letter).cast("long") % 4096
    return x * x * x * x * x


def runs_of(docs: DataFrame, letters: str = LETTERS, at_least: int = 5) -> DataFrame:
    """(doc_id, run): maximal runs of at least ``at_least`` letters of each whole text."""
    found = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"[{letters}]{{{at_least},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def count_words(occurrences: DataFrame, at_least: int = 5, times: int = 3) -> DataFrame:
    """(word, n) of the words of ``at_least`` letters that occur ``times`` times; ``occurrences`` has ``word``."""
    return occurrences.filter(F.char_length("word") >= at_least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorting: tables of words are small in files and large in memory, and a broadcast holds them whole in the driver."""
    return left.join(right.hint("merge"), on, how)


def _halves(word: str, length: Column, kind: str) -> Column:
    """What a single edit may leave in place of a word of ``length`` letters: its first half, or the rest."""
    first = F.shiftright(length, 1)
    head = F.struct(F.lit(f"{kind}<").alias("side"), F.substring(F.col(word), F.lit(1), first).alias("part"))
    tail = F.struct(F.lit(f"{kind}>").alias("side"), F.right(F.col(word), length - first).alias("part"))
    return F.array(head, tail)


def _keyed(words: DataFrame, key: Column, length: Column, kind: str) -> DataFrame:
    """(meets, word): what a word is joined by; equal numbers of different keys only add candidates."""
    rows = words.select("word", key.alias("key"), F.explode(_halves("word", length, kind)).alias("half"))
    return rows.select(F.xxhash64("key", "half.side", "half.part").alias("meets"), "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), each pair once: words that differ by exactly one letter inserted, deleted or replaced."""
    letters = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    spelled = words.select("word", letters.alias("letters"))
    total = F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: F.pmod(s + letter_value(c), F.lit(MODULUS)))
    spelled = spelled.select("word", F.size("letters").alias("size"), total.alias("whole"), F.array_distinct("letters").alias("letters"))
    less = spelled.select("word", "size", "whole", F.explode("letters").alias("letter"))
    less = less.select("word", "size", F.pmod(F.col("whole") - letter_value(F.col("letter")), F.lit(MODULUS)).alias("rest"))

    size, rest = F.col("size"), F.col("rest")
    short = _keyed(spelled, F.col("whole"), size, "removed").withColumnRenamed("word", "a")
    long = _keyed(less, rest, size - 1, "removed").withColumnRenamed("word", "b")
    same = _keyed(less, rest, size, "exchanged")
    other = same.withColumnRenamed("word", "b")
    added = _joined(short, long, "meets")
    exchanged = _joined(same.withColumnRenamed("word", "a"), other, "meets").filter(F.col("a") < F.col("b"))
    met = added.select("a", "b").unionByName(exchanged.select("a", "b"))
    return met.filter(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(forms: DataFrame, most: int, ratio: int, ws: Workspace) -> DataFrame:
    """(word, root) of every word that has a form: counts grow by ``ratio`` along forms, so none is further than log(``most``)."""
    up = forms.select("word", F.col("form").alias("root"))
    longest = max(1, math.ceil(math.log(max(most, 2), ratio)))
    for i in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        to = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = ws.save(_joined(up, to, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots{i}")
    return up


def spelling_variants(words: DataFrame, ws: Workspace, ratio: int = 2) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n; ``ratio`` is at least 2."""
    if ratio < 2:
        raise ValueError("ratio has to be at least 2, or forms could lead back")
    words = ws.save(words.select("word", "n"), "words")
    pairs = ws.save(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = _joined(both, words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("fewer"), F.col("b").alias("near"))).alias("best")
    )
    enough = -F.col("best.fewer") >= ratio * F.col("n")
    near = _joined(words, best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.fewer")).alias("form_n")
    )
    near = ws.save(near, "near")
    most = near.agg(F.max("n")).first()[0] or 0
    ends = roots(near.filter("form IS NOT NULL"), most, ratio, ws)
    return _joined(near, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelled(runs: DataFrame, every: int = 97) -> DataFrame:
    """(word): runs, of which those whose checksum ``every`` divides lose one letter."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def op11_anagram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their most frequent spelling."""
    ws = Workspace(spark, "op11")
    return spelling_variants(count_words(misspelled(runs_of(table(spark, sf_dir, "documents")))), ws)


#: The checksum as SQL: a table of 256 steps, then one step for each byte.
CRC32 = """
steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
)"""


def crc32_of(bytes_list: str) -> str:
    """SQL of the CRC-32 of a list of byte values, beside ``steps``."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def bytes_of(text: str) -> str:
    """SQL of a text's UTF-8 bytes as numbers."""
    return f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT)"


ORACLE = f"""
WITH {CRC32},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[{LETTERS}]+')) AS run FROM documents
),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS tagged, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_of(bytes_of("tagged"))} AS h FROM counted, steps),
spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, i, substr(word, 1, i::INTEGER - 1) || substr(word, i::INTEGER + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT DISTINCT w.word AS a, c.word AS b FROM words w JOIN cuts c ON c.cut = w.word
  UNION SELECT DISTINCT c.word, w.word FROM words w JOIN cuts c ON c.cut = w.word
  UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
),
ranked AS (
  SELECT a, b, m.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY m.n DESC, b) AS k
  FROM near JOIN words m ON m.word = b
),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN b END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.k = 1
),
paths AS (
  WITH RECURSIVE p AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT p.word, f.form FROM p JOIN formed f ON f.word = p.root AND f.form IS NOT NULL
  ) SELECT p.word, p.root FROM p JOIN formed f ON f.word = p.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN paths USING (word)
"""
