"""Operator 10: removal of long repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.
Windows of that length are told apart by suffix arrays, but only where a repeat
is possible: each window has an anchor, its least-hashed short substring, equal
windows have equal anchors, and an anchor that occurs once in the corpus has
nothing to compare. Consecutive windows with one anchor form a run. Runs whose
anchor repeats are dealt by anchor, with their bytes, to shards. A shard folds
equal runs, builds suffix arrays over parts of what is left (Larsson-Sadakane
refinement), takes common prefixes (Kasai), and, where the runs of one
anchor fill several parts, merges these by binary search in their sorted windows. All but the earliest of equal windows are marked.

Before each shuffle a task folds what repeats within it, so a passage that a
third of all documents share reaches a shard at most once from each task.
Answers go back by the partition a text is stored in, as sorted arrays in the
shared folder; texts are stored once and never shuffled.

Edge cases: null text counts as empty; texts shorter than ``length`` keep all;
order is by doc_id (null last), then by a hash of the text among rows that share
an id, then by place of storage; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, local_path, mix64, n_shards, pack, shard_of, table, text_or_empty, unpack, write_file
from lumenreel.llm.runs import _BYTE, _powers, chunks

LENGTH, GRAM = 100, 32
#: Distinct anchors, and bytes of runs, that a task holds before it sends them; bytes of one suffix array,
#: shards of runs for each shuffle partition.
HELD, HELD_BYTES, PART, DEALS = 2_000_000, 16_000_000, 1 << 19, 6
_SEGMENT = np.uint64((1 << 24) - 1)


def _prefix_sums(b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(len(b) + 1)[0][: len(b)], out=total[1:])
    return total


def runs(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Runs of windows of a buffer of texts (text k: offsets[k] to offsets[k + 1] - 1): first start, last start, anchor hash, hash of the run's bytes and layout."""
    out, step = [], 1 << 23
    for at in range(0, max(1, len(b) - length + 1), step):
        out.append(_runs(b[at : at + step + length - 1], offsets - at, length, gram, at))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _runs(b: np.ndarray, offsets: np.ndarray, length: int, gram: int, base: int) -> tuple[np.ndarray, ...]:
    n = len(b) - length + 1
    inside = np.zeros(max(0, n) + 1, np.int32)
    lo, hi = np.clip(offsets[:-1], 0, max(0, n)), np.clip(offsets[1:] - length, 0, max(0, n))  # one byte stands between texts
    some = hi > lo
    np.add.at(inside, lo[some], 1)
    np.add.at(inside, hi[some], -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    total, down = _prefix_sums(b), _powers(len(b) + 1)[1]
    h = mix64((total[gram:] - total[:-gram]) * down[: len(b) - gram + 1])
    least = (h & ~_SEGMENT) | np.arange(len(h), dtype=np.uint64)
    width, target = 1, length - gram + 1
    while 2 * width <= target:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < target:
        least = np.minimum(least[: n], least[target - width : target - width + n])
    anchor = (least[starts] & _SEGMENT).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(anchor) != 0)])
    first, last, anchor = starts[new], starts[np.append(new[1:], len(starts)) - 1], anchor[new]
    whole = (total[last + length] - total[first]) * down[first]
    layout = ((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
    return first + base, last + base, h[anchor], mix64(whole ^ mix64(layout + np.uint64(1)))


def suffix_array(b: np.ndarray) -> np.ndarray:
    """Suffix array by Larsson and Sadakane: groups of equal prefixes are split by the ranks behind the prefix, which doubles."""
    n, depth = len(b), 8
    padded = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    # A suffix shorter than the prefix comes before one that goes on with zero bytes.
    order = np.argsort(key, kind="stable")
    if n > 8 and (b == 0).any() or n <= 8:
        order = np.lexsort((np.minimum(n - np.arange(n), depth), key))
    short = np.minimum(n - order, depth)
    first = np.r_[True, (key[order][1:] != key[order][:-1]) | (short[1:] != short[:-1])] if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        follows = np.append(~first[1:], False) if n else first
        todo = np.flatnonzero(~first | follows)  # members of groups of two or more
        if not len(todo):
            return order
        suffix = order[todo]
        group, behind = rank[suffix], rank[np.minimum(suffix + depth, n)]
        by = np.lexsort((behind, group))
        suffix, group, behind = suffix[by], group[by], behind[by]
        order[todo] = suffix
        split = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        first[todo] = split
        rank[suffix] = todo[np.maximum.accumulate(np.where(split, np.arange(len(todo)), 0))]
        depth *= 2


def common_prefixes(b: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Kasai: length of the prefix that each suffix shares with the one before it; lengths beyond ``most`` make no difference and count as that.

    Stretches of the text are gone through in step; within one, the length falls
    by at most one from a suffix to the next.
    """
    n = len(b)
    before, rank = np.full(n, -1, np.int64), np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    rank[order] = np.arange(n)
    text, out = np.concatenate([b, np.zeros(1, np.uint8)]), np.zeros(n, np.int64)
    i, h = np.arange(0, n, lane), np.zeros(-(-n // lane), np.int64)
    end = np.minimum(i + lane, n)
    while len(i):
        j = before[i]
        same = (j >= 0) & (i + h < n) & (j + h < n) & (h < most) & (text[np.minimum(i + h, n)] == text[np.minimum(np.maximum(j, 0) + h, n)])
        done = np.flatnonzero(~same)
        out[i[done]] = h[done]
        h = np.where(same, h + 1, np.maximum(h - 1, 0))
        i = np.where(same, i, i + 1)
        if len(done) and (live := i < end).sum() < len(i):
            i, h, end = i[live], h[live], end[live]
    return out[order]


def sorted_windows(b: np.ndarray, is_window: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order with the least place of each, and the places that are not least. ``place`` orders windows."""
    order = suffix_array(b)
    group = np.cumsum(common_prefixes(b, order, length) < length)
    keep = is_window[order]
    order, group = order[keep], group[keep]
    by = np.lexsort((place[order], group))
    order, group = order[by], group[by]
    first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    windows = np.lib.stride_tricks.sliding_window_view(b, length)[order[first]] if first.any() else np.zeros((0, length), np.uint8)
    return np.ascontiguousarray(windows).view(f"S{length}").reshape(-1), place[order[first]], place[order[~first]]


def merge_windows(a: tuple, c: tuple) -> tuple:
    """Two sorted sets of windows as one: equal windows are found by binary search, the later place loses."""
    (win, at, lost), (win2, at2, lost2) = a, c
    where = np.searchsorted(win, win2)
    equal = np.zeros(len(win2), bool)
    inner = where < len(win)
    equal[inner] = win[where[inner]] == win2[inner]
    old, new = at[where[equal]], at2[equal]
    at = at.copy()
    at[where[equal]] = np.minimum(old, new)
    fresh = ~equal
    return np.insert(win, where[fresh], win2[fresh]), np.insert(at, where[fresh], at2[fresh]), np.concatenate([lost, lost2, np.maximum(old, new)])


def later_windows(contents: list[bytes], place: list[np.ndarray], length: int, part: int = PART) -> np.ndarray:
    """Places of all windows of the contents that are not the least of their kind."""
    parts, at = [], 0
    while at < len(contents):
        end, size = at, 0
        while end < len(contents) and (end == at or size + len(contents[end]) <= part):
            size += len(contents[end]) + 1
            end += 1
        b = np.frombuffer(b"\0".join(contents[at:end]), np.uint8)
        is_window, of = np.zeros(len(b), bool), np.zeros(len(b), np.int64)
        start = 0
        for x, p in zip(contents[at:end], place[at:end], strict=True):
            is_window[start : start + len(p)], of[start : start + len(p)] = True, p
            start += len(x) + 1
        parts.append(sorted_windows(b, is_window, of, length))
        at = end
    while len(parts) > 1:
        parts = [reduce(merge_windows, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0][2] if parts else np.zeros(0, np.int64)


class _Rows:
    """Arrow batches as buffers of texts, with the columns of their rows."""

    def __init__(self, batches):
        self.batches = batches

    def __iter__(self):
        for batch in self.batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                uid, doc, tie = (some.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for first, last, data, offsets in chunks(some.column(3).to_pylist(), False):
                    yield np.frombuffer(data, np.uint8), offsets, uid[first:last], doc[first:last], tie[first:last]


def _by_pid(uid: np.ndarray):
    pid = uid >> 33
    for p in np.unique(pid).tolist():
        yield p, np.flatnonzero(pid == p)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def stored(docs: DataFrame, ws: Workspace) -> DataFrame:
    """uid (partition and row), doc (its order), tie, text and doc_id, kept as a table."""
    rows = text_or_empty(docs).select(F.monotonically_increasing_id().alias("uid"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tie"), "text", "doc_id")
    return ws.save(rows, "texts")


def mark(spark: SparkSession, rows: DataFrame, ws: Workspace, length: int = LENGTH, gram: int = GRAM) -> str:
    """Files of marked windows, one for each stored partition: uid, first and last start of runs of marked windows, in order."""
    shards, folder = n_shards(spark), ws.mkdir("marks")
    deals = DEALS * shards  # runs carry bytes, so their shards are smaller
    texts = rows.select("uid", "doc", "tie", "text")

    def send_anchors(batches):
        names, kinds = ["shard", "pid", "m"], [pa.int32(), pa.int64(), pa.binary()]
        held: dict[int, list] = {}

        def send():
            for pid, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                cuts = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
                out = [(s, pid, pack(h[lo:hi], (n[lo:hi] > 1).astype(np.uint8))) for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
                if out:
                    yield _batch(out, names, kinds)
            held.clear()

        for b, offsets, uid, _, _ in _Rows(batches):
            first, _, h, _ = runs(b, offsets, length, gram)
            of = uid[np.searchsorted(offsets, first, "right") - 1]
            for pid, some in _by_pid(of):
                held.setdefault(pid, []).append(h[some])
            if sum(len(x) for p in held.values() for x in p) > HELD:
                yield from send()
        yield from send()

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(m) for m in pdf.m]
        h, many = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        pid = np.repeat(pdf.pid.to_numpy(np.int64), [len(p[0]) for p in parts])
        order = np.argsort(h, kind="stable")
        h, many, pid = h[order], many[order] > 0, pid[order]
        same = h[1:] == h[:-1]
        again = many | np.r_[False, same] | np.r_[same, False] if len(h) else many
        h, pid = h[again], pid[again]
        return pd.DataFrame([(p, pack(np.unique(h[pid == p]))) for p in np.unique(pid).tolist()], columns=["pid", "m"])

    def write_wanted(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(np.concatenate([unpack(m)[0] for m in pdf.m]))
        write_file(f"{folder}/wanted-{key[0]}", h.tobytes())
        return pd.DataFrame({"n": [len(h)]})

    wanted = texts.mapInArrow(send_anchors, "shard int, pid long, m binary").groupBy("shard").applyInPandas(repeated, "pid long, m binary")
    wanted.groupBy("pid").applyInPandas(write_wanted, "n long").agg(F.sum("n")).collect()  # one number

    def read(name: str, dtype) -> np.ndarray:
        path = local_path(f"{folder}/{name}")
        return np.memmap(path, dtype, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)

    def send_runs(batches):
        """kind 0: runs dealt to shards by anchor; kind 1: marked runs dealt by stored partition."""
        names, kinds = ["kind", "to", "m", "content"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        files: dict[int, np.ndarray] = {}
        held: list[list] = []
        marked: list[list] = []

        def fold(columns: list, content: np.ndarray):
            """Of equal runs the earliest stays, the others are marked."""
            h, k, doc, tie, uid, first, _ = columns
            order = np.lexsort((first, uid, tie, doc, k, h))
            lead = np.r_[True, (h[order][1:] != h[order][:-1]) | (k[order][1:] != k[order][:-1])] if len(h) else np.zeros(0, bool)
            rest = order[~lead]
            marked.append([uid[rest], first[rest], first[rest] + columns[6][rest]])
            return [c[order[lead]] for c in columns], content[order[lead]]

        def send():
            if held:
                columns, content = [np.concatenate(c) for c in zip(*[x[0] for x in held], strict=True)], np.concatenate([x[1] for x in held])
                columns, content = fold(columns, content)
                cuts = np.searchsorted(shard_of(columns[0], deals), np.arange(deals + 1))
                for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if lo < hi:
                        yield _batch([(0, s, pack(*[c[lo:hi] for c in columns]), zlib.compress(b"".join(content[lo:hi]), 1))], names, kinds)
            if marked:
                uid, first, last = (np.concatenate(c) for c in zip(*marked, strict=True))
                for pid, some in _by_pid(uid):
                    yield _batch([(1, pid, pack(uid[some], first[some], last[some]), b"")], names, kinds)
            held.clear()
            marked.clear()

        size = 0
        for b, offsets, uid, doc, tie in _Rows(batches):
            first, last, h, k = runs(b, offsets, length, gram)
            of = np.searchsorted(offsets, first, "right") - 1
            take = np.zeros(len(first), bool)
            for pid, some in _by_pid(uid[of]):
                if pid not in files:
                    files[pid] = read(f"wanted-{pid}", np.uint64)
                if len(w := files[pid]):
                    at = np.minimum(np.searchsorted(w, h[some]), len(w) - 1)
                    take[some] = w[at] == h[some]
            first, last, h, k, of = (x[take] for x in (first, last, h, k, of))
            local = first - offsets[of]
            where = np.arange(len(first))
            columns, where = fold([h, k, doc[of], tie[of], uid[of], local, last - first], where)
            raw = b.tobytes()
            content = np.empty(len(where), object)
            content[:] = [raw[s : e + length] for s, e in zip(first[where].tolist(), last[where].tolist(), strict=True)]
            held.append([columns, content])
            size += int((columns[6] + length).sum()) + 100 * len(where)
            if size > HELD_BYTES:
                yield from send()
                size = 0
        yield from send()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(m) for m in pdf.m]
        h, k, doc, tie, uid, first, span = (np.concatenate([p[i] for p in parts]) for i in range(7))
        content = []
        for p, raw in zip(parts, pdf.content, strict=True):
            data, ends = zlib.decompress(raw), np.cumsum(p[6] + length).tolist()
            content += [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        content = np.array([*content, None], object)[:-1]
        order = np.lexsort((first, uid, tie, doc, content_number(content, k), k, h))
        h, k, doc, tie, uid, first, span, content = (x[order] for x in (h, k, doc, tie, uid, first, span, content))
        same = np.r_[False, (h[1:] == h[:-1]) & (k[1:] == k[:-1])]
        same[1:] &= np.array([x == y for x, y in zip(content[1:], content[:-1], strict=True)], bool)
        marks = [np.stack([uid[same], first[same], first[same] + span[same]], axis=1)]
        h, doc, tie, uid, first, span, content = (x[~same] for x in (h, doc, tie, uid, first, span, content))
        twice = np.zeros(len(h), bool)  # anchors that still have several runs
        twice[1:] |= h[1:] == h[:-1]
        twice[:-1] |= h[1:] == h[:-1]
        h, doc, tie, uid, first, span, content = (x[twice] for x in (h, doc, tie, uid, first, span, content))
        if len(doc):
            # Windows are numbered in the order of documents and places.
            order = np.lexsort((first, uid, tie, doc))
            base = np.empty(len(order), np.int64)
            base[order] = np.cumsum(span[order] + 1) - (span[order] + 1)
            lost = np.sort(np.concatenate([later_windows(content[lo:hi].tolist(), [np.arange(x, x + n + 1) for x, n in zip(base[lo:hi].tolist(), span[lo:hi].tolist(), strict=True)], length) for lo, hi in _batches(h, span + length)]))
            of = order[np.searchsorted(base[order], lost, "right") - 1]
            start = first[of] + lost - base[of]
            new = np.flatnonzero(np.r_[True, (np.diff(lost) != 1) | (np.diff(of) != 0)]) if len(lost) else np.zeros(0, np.int64)
            marks.append(np.stack([uid[of[new]], start[new], start[np.append(new[1:], len(lost)) - 1]], axis=1) if len(lost) else np.zeros((0, 3), np.int64))
        marks = np.concatenate(marks)
        return pd.DataFrame([(p, pack(*marks[some].T)) for p, some in _by_pid(marks[:, 0])], columns=["to", "m"])

    def write_marks(key, pdf: pd.DataFrame) -> pd.DataFrame:
        uid, first, last = (np.concatenate(c) for c in zip(*map(unpack, pdf.m), strict=True))
        order = np.lexsort((first, uid))
        marks = np.stack([uid[order], first[order], last[order]], axis=1).astype("<i8")
        write_file(f"{folder}/marks-{key[0]}", marks.tobytes())
        return pd.DataFrame({"n": [len(marks)]})

    sent = ws.save(texts.mapInArrow(send_runs, "kind int, to long, m binary, content binary"), "runs")
    found = sent.filter("kind = 0").select("to", "m", "content").groupBy("to").applyInPandas(compare, "to long, m binary")
    found = found.union(sent.filter("kind = 1").select("to", "m"))
    found.groupBy("to").applyInPandas(write_marks, "n long").agg(F.sum("n")).collect()  # one number
    ws.drop("runs")
    return folder


def _batches(h: np.ndarray, sizes: np.ndarray, part: int = PART):
    """Stretches of whole anchors, about ``part`` bytes each: only equal anchors have windows to compare."""
    starts = np.append(np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h))
    ends, lo = np.append(0, np.cumsum(sizes)), 0
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if a > lo and ends[b] - ends[lo] > part:
            yield lo, a
            lo = a
    yield lo, len(h)


def content_number(content: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Numbers that tell apart unequal contents of one hash (all but always 0)."""
    seen: dict[int, dict[bytes, int]] = {}
    return np.array([(d := seen.setdefault(x, {})).setdefault(c, len(d)) for x, c in zip(k.tolist(), content, strict=True)], np.int64)


def without_repeats(spark: SparkSession, docs: DataFrame, ws: Workspace, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) and kept_sha256 of every row."""
    rows = stored(docs, ws)
    folder = mark(spark, rows, ws, length, gram)

    def apply(batches):
        files: dict[int, np.ndarray] = {}
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for uid, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    if (pid := uid >> 33) not in files:
                        path = local_path(f"{folder}/marks-{pid}")
                        files[pid] = np.memmap(path, "<i8", "r").reshape(-1, 3) if os.path.exists(path) and os.path.getsize(path) else np.zeros((0, 3), np.int64)
                    m = files[pid]
                    lo, hi = np.searchsorted(m[:, 0], [uid, uid + 1])
                    raw = text.encode("utf-8", "surrogatepass")
                    removed = spans = 0
                    kept = raw
                    if lo < hi:
                        first, end = m[lo:hi, 1], np.maximum.accumulate(m[lo:hi, 2] + length)
                        new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
                        starts, ends = first[new], end[np.append(new[1:], hi - lo) - 1]
                        removed, spans = int((ends - starts).sum()), len(new)
                        kept = b"".join([raw[s:e] for s, e in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True)])
                    out.append((doc_id, len(raw), removed, spans, kept, hashlib.sha256(kept).hexdigest()))
                yield _batch(out, names, kinds)

    return rows.select("uid", "doc_id", "text").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(spark, table(spark, sf_dir, "documents"), Workspace(spark, "op10"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
