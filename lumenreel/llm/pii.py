"""Operator 1: personal data by fixed forms and bootstrapped contexts.

Four forms (mail address, IP address, card, phone) give base spans. They seed a
graph of instances (values) and lexical patterns (the words around a value).
Other instances are stretches of neighbouring words that all hold a digit, names
joined by inner signs, and mail addresses spelled out in words. Spark scores both
sides of the graph in turn: a pattern by the share of its distinct values that
are trusted, a value by how far the patterns it occurs in are trusted on average,
so a value that is also at home elsewhere is turned down. Rounds go on until no
pattern and no value is added. Only hashes of values and patterns are counted, so
the graph grows with the number of such values, not of words; hot patterns are
pre-aggregated.

Edge cases: null text counts as empty; rows without a doc_id and repeated rows are
searched each; texts are searched whole, in time that is linear in their length;
a value that two kinds claim gets the kind of the pattern with more confidence,
and of equal ones the first as listed; digits and letters of the forms are ASCII,
so others are never matched; an empty table gives no rows; other columns,
whatever their names, are ignored by ``find`` and kept by ``redact`` (names that
end in two underscores are its own).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, table, trim

KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time: a mail address is found from its sign, the first number of an IP address starts a run of digits.
_AFTER_AT, _LOCAL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_FORM = {"ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), "card": re.compile(FORMS["card"]), "phone": re.compile(FORMS["phone"])}
_DIGIT, _RUN, _NUMBER = re.compile("[0-9]"), re.compile(r"[^\W_]+"), re.compile("[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names of letters joined by inner signs, and addresses with the signs spelled out.
_JOINED = re.compile(r"(?<![^\W_])[^\W\d_]++(?:[._@-][^\W\d_]++)+(?![^\W_])")
_SPELLED = re.compile(r"(?<![^\W_])[^\W_]++ [(\[]?at[)\]]? [^\W_]++(?: [(\[]?dot[)\]]? [^\W_]++)+", re.IGNORECASE)
#: Distinct trusted values a pattern needs; least confidence of a pattern, and least mean confidence around a value.
SUPPORT, CONFIDENCE, AT_HOME = 3, 0.8, 0.4


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _holds(kind: str, value: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in value.split("."))
    digits = re.sub("[^0-9]", "", value)
    return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str):
    """Leftmost matches that do not overlap: the longest run before each sign, and the domain behind it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place of the kind) of all forms, in order."""
    digit = _DIGIT.search(text) is not None
    out = [(s, e, 0) for s, e in _emails(text)]
    for k, kind in enumerate(KINDS[1:], 1):
        if digit and ("+" in text or kind != "phone") and ("." in text or kind != "ip"):
            out += [(m.start(), m.end(), k) for m in _FORM[kind].finditer(text) if _holds(kind, m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def other_values(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be values, from letter or digit to letter or digit, that touch no base span and not each other."""
    ends: list[int] = []  # furthest end of the base spans so far: spans of one place in order have ends that never fall
    for _, e, _ in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _, _ in taken]

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or ends[k - 1] <= s

    found = [m.span() for m in _SPELLED.finditer(text)] if " dot" in text or "dot]" in text or "dot)" in text else []
    held, last = None, 0
    for m in _DIGIT.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] not in "\x20\x09\x0a\x0b\x0c\x0d":
            start -= 1
        end = w.end() if (w := _WORD.match(text, m.start())) else m.end()
        if not free(start, end):
            start = end
        if held and start < end and text[held[1] : start] == " ":
            held[1] = end
        else:
            if held:
                found.append(tuple(held))
            held = [start, end] if start < end else None
        last = end
    if held:
        found.append(tuple(held))
    found += [m.span() for m in _JOINED.finditer(text)]
    out, busy = [], []
    for s, e in sorted(set(found), key=lambda x: (x[0], -x[1])):
        if free(s, e) and (not busy or busy[-1] <= s):
            first, back = _RUN.search(text, s, e), e
            while back > s and not (text[back - 1].isalnum()):
                back -= 1
            if first and back > first.start():
                out.append((first.start(), back))
                busy.append(e)
    return out


class Contexts:
    """Patterns around the spans of one text: its words (letters and digits) are found once."""

    def __init__(self, text: str):
        self.text, self.runs = text, [m.span() for m in _RUN.finditer(text)]
        self.starts, self.ends = [s for s, _ in self.runs], [e for _, e in self.runs]

    def word(self, k: int) -> str:
        s, e = self.runs[k]
        return _NUMBER.sub("0", self.text[s:e].lower())

    def __call__(self, start: int, end: int) -> list[int]:
        """Hashes of the whole words around a span: two before it, and one on each side."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        left = [self.word(k) for k in range(max(0, before - 2), before)]
        right = self.word(after) if after < len(self.runs) else None
        found = []
        if len(left) == 2:
            found.append(f"{left[0]} {left[1]} _")
        if left and right:
            found.append(f"{left[-1]} _ {right}")
        return [_hash(p) for p in found]


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_OCC = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
_OCC_DDL = "array<struct<s:long,e:long,kind:int,value:long,patterns:array<long>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, uid, the base columns and ``occ``: spans with their values and patterns (kind null: not a base span)."""

    def find(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, rows = batch.slice(at, 500), []
                for text in some.column(2).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans = [*base, *[(s, e, None) for s, e in other_values(text, base)]]
                    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in base)
                    around = Contexts(text) if spans else None
                    occ = [{"s": s, "e": e, "kind": k, "value": _hash(text[s:e].lower()), "patterns": around(s, e)} for s, e, k in spans]
                    rows.append(([sum(b[2] == k for b in base) for k in range(len(KINDS))], hashlib.sha256(joined.encode()).hexdigest(), occ))
                counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *counts, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], _OCC)], names=["doc_id", "uid", *[f"n_{k}" for k in KINDS], "base_sha256", "occ"])
        trim()

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    return rows.mapInArrow(find, f"doc_id long, uid long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, occ {_OCC_DDL}")


def bootstrap(scanned: DataFrame, ws: Workspace, support: int = SUPPORT, confidence: float = CONFIDENCE, at_home: float = AT_HOME) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, confidence) and values (value, kind, score) once scoring the graph in turn adds nothing."""
    occ = scanned.select(F.inline("occ")).select("value", "kind", F.explode("patterns").alias("pattern"))
    graph = ws.save(occ.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "graph")
    sizes = ws.save(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "sizes")
    open_graph = graph.filter("kind is null").select("pattern", "value")
    homes = ws.save(open_graph.groupBy("value").agg(F.count(F.lit(1)).alias("homes")), "homes")
    seeds = ws.save(graph.filter("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score")), "seeds")
    values, known, i = seeds, None, 0
    while True:
        held = graph.select("pattern", "value").join(values, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("trusted"))
        held = held.filter(F.col("trusted") >= support).join(sizes, "pattern").withColumn("confidence", F.col("trusted") / F.col("n"))
        trusted = ws.save(held.filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence"), f"patterns{i}")
        scored = open_graph.join(trusted, "pattern").groupBy("value", "kind").agg(F.sum("confidence").alias("sum")).join(homes, "value")
        scored = scored.select("value", "kind", (F.col("sum") / F.col("homes")).alias("score")).filter(F.col("score") >= at_home)
        values = ws.save(seeds.unionByName(scored), f"values{i}")
        now = (trusted.count(), values.count())
        # Both only grow as long as something is added; scores that still move within their sets decide nothing more.
        if known is not None and (now[0] <= known[0] and now[1] <= known[1]):
            return trusted, values
        known, i = now, i + 1


def find(docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, uid, counts and hash of the base spans, ``found`` (all spans: s, e, kind) and ``n_found`` (beyond the base)."""
    scanned = ws.save(scan(docs), "scanned")
    trusted, values = bootstrap(scanned, ws)
    open_occ = scanned.select("uid", F.inline("occ")).filter("kind is null").select("uid", "s", "e", "value", F.explode("patterns").alias("pattern"))
    hits = open_occ.join(trusted, "pattern").join(values.select("value", "kind"), ["value", "kind"])
    best = hits.groupBy("uid", "s", "e").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = best.groupBy("uid").agg(F.collect_list(F.struct("s", "e", "kind")).alias("more"))
    none = F.array().cast("array<struct<s:long,e:long,kind:int>>")
    base = F.transform(F.filter("occ", lambda x: x.kind.isNotNull()), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind")))
    joined = scanned.join(more, "uid", "left").withColumn("more", F.coalesce("more", none))
    by_start = F.array_sort(F.transform(F.concat(base, "more"), lambda x: F.struct(x.s.alias("s"), x.kind.alias("kind"), x.e.alias("e"))))
    return joined.withColumns({"found": by_start, "n_found": F.size("more").cast("long")}).drop("occ", "more")


def spans_text() -> object:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def redact(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets, and ``n_chars`` (if there is one) counted anew."""
    stored = ws.save(docs.withColumn("uid__", F.monotonically_increasing_id()), "docs")
    found = find(stored.select(F.col("uid__").alias("doc_id"), "text"), ws)
    spans = found.filter(F.size("found") > 0).select(F.col("doc_id").alias("uid__"), F.col("found").alias("found__"))
    columns = stored.join(spans, "uid__", "left").select(*docs.columns, "found__")

    def apply(batches):
        for pdf in batches:
            pdf["text"] = [_cut(t, f) for t, f in zip(pdf.text, pdf.found__, strict=True)]
            yield pdf.drop(columns="found__")

    touched = columns.filter("found__ is not null").mapInPandas(apply, docs.schema)
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return columns.filter("found__ is null").drop("found__").unionByName(touched)


def _cut(text: str, found) -> str:
    out, at = [], 0
    for x in found:
        if x["s"] >= at:
            out += [text[at : x["s"]], f"<{KINDS[x['kind']]}>"]
        at = max(at, x["e"])
    return "".join([*out, text[at:]])


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op1"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans_text().alias("spans"), "n_found")
