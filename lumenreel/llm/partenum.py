"""Operator 9: Jaccard join of word n-gram sets by PartEnum signatures.

Sets are grouped into bands of nearly equal size. Within two neighbouring bands
a Jaccard similarity of at least ``num/den`` bounds the number of features on
which two sets differ by k. The feature domain is cut into about k/2 parts, each
part into a few cells; in some part the two sets differ in at most one cell, so
leaving out one cell of a part at a time gives signatures of which they share at
least one. Candidates are verified exactly.

Equal sets fold into one node before anything else. Links are only needed up to
connection, so the first pass verifies each node against one node that shares
signatures with it, and the second compares, under every signature, only nodes
that are not connected yet: first with the node of each list that shares most with others (often
the text that the others are copies of), then all with all. Before sets are compared, pairs pass filters that no true link can
fail: sizes, and the bits in which two parity sketches differ. Signatures that
several nodes share are kept as lists of nodes; pairs of one list are looked at in
blocks within a task and only those that pass the filters leave it.

Edge cases: null and empty texts have an empty set, no links and their own id;
rows that share a doc_id or a set share a component; rows without an id are
returned with the component of their set (null if no row of it has an id);
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, mix64, n_shards, pack, shard_of, table, text_or_empty, trim, unpack
from lumenreel.llm.components import components
from lumenreel.llm.runs import word_hashes

N, NUM, DEN = 4, 85, 100
#: Signatures held by a task before they are sent on; bits of a sketch.
HELD, SKETCH = 1_000_000, 256
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(texts: list[str], n: int = N):
    """Sorted distinct 64-bit shingle hashes of each text, in order."""
    for first, last, h, offsets in word_hashes(texts):
        if n > len(_ODD):
            raise ValueError(f"at most {len(_ODD)} words a shingle")
        many = max(0, len(h) - n + 1)
        grams = sum((h[i : i + many] * _ODD[i] for i in range(n)), np.zeros(many, np.uint64))
        grams = mix64(grams)
        for a, b in pairwise(offsets.tolist()):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield s[np.flatnonzero(np.diff(s, prepend=s[0] + np.uint64(1)))] if len(s) > 1 else s
            elif b > a:
                whole = sum((h[a + i : a + i + 1] * _ODD[i] for i in range(b - a)), np.full(1, b - a, np.uint64))
                yield mix64(mix64(whole))
            else:
                yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """One number for equal sets."""
    return int(mix64((mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))).reshape(1)).view(np.int64)[0])


class Bands:
    """Size bands and, by band, how the domain is partitioned for pairs whose larger set is in it."""

    def __init__(self, num: int = NUM, den: int = DEN, top: int = 1 << 40):
        self.num, self.den, starts, left = num, den, [], 1
        while left < top:
            starts.append(left)
            left = left * den // num + 1
        self.starts = np.array([*starts, left], np.int64)
        k = 2 * (self.starts[1:] - 1) * (den - num) // (den + num)
        self.parts = np.maximum(1, (k + 2) // 2)
        self.cells = np.where(k == 0, 1, np.where(k <= 12, 4, 3))

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and the place in ``sets`` of each."""
        sizes = np.array([len(s) for s in sets], np.int64)
        owner, x = np.repeat(np.arange(len(sets)), sizes), mix64(np.concatenate([*sets, np.zeros(0, np.uint64)]) + np.uint64(1))
        value, hi, lo = mix64(x), x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
        out = []
        for up in (0, 1):  # pairs whose larger set is in this set's own band, or in the next one
            band = np.searchsorted(self.starts, np.maximum(1, sizes), "right") - 1 + up
            parts, cells = np.where(sizes > 0, self.parts[band], 0), self.cells[band]
            base = np.cumsum(parts * cells) - parts * cells
            part = (hi * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            cell = (lo * cells[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(int((parts * cells).sum()), np.uint64)
            np.add.at(sums, base[owner] + part * cells[owner] + cell, value)
            of = np.repeat(np.arange(len(sets)), parts * cells)
            place = np.arange(len(sums)) - base[of]
            left_out = np.zeros(len(sums), np.uint64)
            for c in np.unique(cells):
                rows = np.flatnonzero(cells[of] == c)
                whole = sums[rows].reshape(-1, c).sum(axis=1, dtype=np.uint64)
                left_out[rows] = np.repeat(whole, c) - (sums[rows] if c > 1 else np.uint64(0))
            key = mix64(band[of].astype(np.uint64) * np.uint64(1 << 40) + place.astype(np.uint64))
            out.append((mix64(left_out ^ key), of))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def sketch(s: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parity bits: two sets differ in at least as many features as their sketches in bits."""
    bits = np.bincount((mix64(s + np.uint64(77)) >> np.uint64(32)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def long_sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """A sketch with eight or more bits for each feature in which a linked set may differ; a power of two."""
    return sketch(s, max(SKETCH, 1 << (16 * len(s) * (den - num) // (den + num)).bit_length())).tobytes()


def sketches_differ(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the shorter one's size."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _messages(sig: np.ndarray, of: np.ndarray, nodes: np.ndarray, *columns: np.ndarray, shards: int):
    """(shard, signatures, nodes) for each shard: signatures with the place of their node among the message's nodes."""
    order = np.argsort(sig)
    sig, of = sig[order], of[order]
    cuts = np.searchsorted(shard_of(sig, shards), np.arange(shards + 1))
    for s in range(shards):
        lo, hi = cuts[s], cuts[s + 1]
        if lo < hi:
            some, place = np.unique(of[lo:hi], return_inverse=True)
            yield s, pack(sig[lo:hi], place.astype(np.uint32)), pack(nodes[some].view(np.uint64), *[c[some] for c in columns])


def _gather(pdf: pd.DataFrame) -> list[np.ndarray]:
    """Signatures, nodes and the nodes' columns, one entry for each signature, in the order of signatures and nodes."""
    rows = [(unpack(m), unpack(x)) for m, x in zip(pdf.m, pdf.nodes, strict=True)]
    sig = np.concatenate([m[0] for m, _ in rows])
    columns = [np.concatenate([x[i][m[1]] for m, x in rows]) for i in range(len(rows[0][1]))]
    order = np.lexsort((columns[0], sig))
    sig, columns = sig[order], [c[order] for c in columns]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (columns[0][1:] != columns[0][:-1])
    return [sig[keep], *[c[keep] for c in columns]]


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leader, member, number of shared signatures) where entries are in the order of signatures; the first leads."""
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    lead = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    pairs = np.stack([node[~first], lead[~first]], axis=1)
    if not len(pairs):
        return pairs[:, 1], pairs[:, 0], np.zeros(0, np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    start = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
    return pairs[start, 1], pairs[start, 0], np.diff(np.append(start, len(pairs)))


def _deal(lead: np.ndarray, member: np.ndarray, n: np.ndarray, shards: int):
    """Stars dealt by member."""
    shard = shard_of(mix64(member.view(np.uint64)), shards)
    for s in np.unique(shard):
        rows = np.flatnonzero(shard == s)
        yield int(s), pack(member[rows].view(np.uint64), lead[rows], n[rows])


def _carry(nodes: np.ndarray, roots: np.ndarray, weights: np.ndarray, sketches: list[bytes], rows: np.ndarray) -> tuple[bytes, bytes]:
    """Some nodes with their roots, weights and sketches as two byte strings."""
    some = [sketches[r] for r in rows]
    return pack(nodes[rows], roots[rows], weights[rows], np.array([len(x) for x in some], np.uint32)), b"".join(some)


def _carried(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The same of all rows, in the order of nodes."""
    parts, k = [unpack(m) for m in pdf.m], []
    for (*_, sizes), data in zip(parts, pdf.k, strict=True):
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        k += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    nodes, roots, weights = (np.concatenate([*[p[i] for p in parts], np.zeros(0, t)]) for i, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
    order = np.argsort(nodes)
    return nodes[order], roots[order], weights[order], [k[i] for i in order]


def _cross(node: np.ndarray, size: np.ndarray, label: np.ndarray, sketches: list[bytes], hub: int | None, num: int, den: int, words: int = 1 << 21):
    """Pairs of one list (with its hub, or all) that are not connected and pass both filters."""
    values, inverse, n = np.unique(label, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(inverse != np.argmax(n)) if hub is None else np.array([hub])
    wide = [np.frombuffer(x, np.uint64) for x in sketches]
    width = min(map(len, wide))
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in wide])
    step = max(1, words // (len(node) * width))
    for at in range(0, len(rest), step):
        rows = rest[at : at + step]
        a, b = size[rows, None], size[None, :]
        i, j = np.nonzero((label[rows, None] != label[None, :]) & (np.minimum(a, b) * den >= np.maximum(a, b) * num))
        differ = np.bitwise_count(bits[rows[i]] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = differ * (den + num) <= (size[rows[i]] + size[j]) * (den - num)
        a, b = node[rows[i[near]]], node[j[near]]
        yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def jaccard_classes(spark: SparkSession, docs: DataFrame, ws: Workspace, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, node (one number for each distinct set, null if empty) and component_id of every row."""
    shards, bands = n_shards(spark), Bands(num, den)

    def sign(batches):
        """Rows of documents, and messages of signatures to shards."""
        names = ["doc_id", "lone", "n_shingles", "node", "k", "shard", "m", "nodes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        held: list[tuple] = []
        seen: set[int] = set()

        def send():
            nodes, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            at = np.cumsum([0, *[len(h[0]) for h in held]])
            sig, of = np.concatenate([h[2] for h in held]), np.concatenate([h[3] + a for h, a in zip(held, at, strict=False)])
            held.clear()
            seen.clear()
            rows = list(_messages(sig, of, nodes, sizes, shards=shards))
            for at in range(0, len(rows), 4):  # messages are large: few of them in a batch
                columns = [*[[None] * len(rows[at : at + 4])] * 5, *map(list, zip(*rows[at : at + 4], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = list(shingle_sets(some.column(1).to_pylist(), n))
                ids = [node_of(s) if len(s) else None for s in sets]
                columns = [some.column(0).to_pylist(), some.column(2).to_pylist(), [len(s) for s in sets], ids, [long_sketch(s, num, den) if len(s) else None for s in sets], *[[None] * len(sets)] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
                new = {}
                for i, s in zip(ids, sets, strict=True):
                    if i is not None and i not in seen:
                        new[i] = s
                seen.update(new)
                if new:
                    held.append((np.array(list(new), np.int64), np.array([len(s) for s in new.values()], np.int64), *bands.signatures(list(new.values()))))
                if sum(len(h[2]) for h in held) > HELD:
                    yield from send()
        if held:
            yield from send()
        trim()

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """kind 1: stars dealt by member; kind 2: lists of two or more nodes, each list once, kept by shard; kind 3: the sizes of a node's lists, dealt by node."""
        sig, node, size = _gather(pdf)
        node = node.view(np.int64)
        rows = [(1, s, m) for s, m in _deal(*_stars(sig, node), shards)]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        many, mark = np.diff(np.append(start, len(sig))), np.add.reduceat(mix64(node.view(np.uint64)), start)
        start, many, mark = start[many > 1], many[many > 1], mark[many > 1]
        _, once = np.unique(mark, return_index=True)
        start, many = start[once], many[once]
        if len(start):
            lists = np.repeat(np.arange(len(start)), many)
            at = np.arange(len(lists)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
            rows.append((2, key[0], pack(lists, node[at], size[at])))
            nodes, inverse = np.unique(node[at].view(np.uint64), return_inverse=True)
            weight, to = np.bincount(inverse, weights=many[lists]).astype(np.int64), shard_of(mix64(nodes), shards)
            rows += [(3, int(t), pack(nodes[to == t], weight[to == t])) for t in np.unique(to)]
        del sig, node, size
        trim()
        return pd.DataFrame(rows, columns=["kind", "shard", "m"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each member's leaders the one with which it shares most."""
        member, lead, count = (np.concatenate(c) for c in zip(*map(unpack, pdf.m), strict=True))
        member = member.view(np.int64)
        order = np.lexsort((lead, member))
        member, lead, count = member[order], lead[order], count[order]
        start = np.flatnonzero(np.r_[True, (member[1:] != member[:-1]) | (lead[1:] != lead[:-1])])
        member, lead, count = member[start], lead[start], np.add.reduceat(count, start)
        order = np.lexsort((lead, -count, member))
        first = order[np.r_[True, member[order][1:] != member[order][:-1]]]
        return pd.DataFrame({"a": lead[first], "b": member[first]})

    def load(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = list(shingle_sets(some.column(1).to_pylist(), n))
                keep = [i for i, (s, want) in enumerate(zip(sets, some.column(0).to_pylist(), strict=True)) if len(s) and node_of(s) == want]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "s"])
        trim()

    def may_link(batches):
        for batch in batches:
            na, nb, ka, kb = (c.to_pylist() for c in batch.columns[2:])
            keep = pa.array([i for i, (x, y, p, q) in enumerate(zip(na, nb, ka, kb, strict=True)) if sketches_differ(p, q) * (den + num) <= (x + y) * (den - num)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    def verify(batches):
        for batch in batches:
            a, b, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if den * both >= num * ((len(x) + len(y)) // 8 - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    def ask(batches):
        """Nodes of the lists, dealt by node."""
        for batch in batches:
            for shard, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                nodes = np.unique(unpack(m)[1]).view(np.uint64)
                to = shard_of(mix64(nodes), shards)
                rows = [(int(t), shard, pack(nodes[to == t])) for t in np.unique(to)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "shard", "m"])

    def bucket(batches):
        """Nodes with their roots, weights and sketches, dealt by node."""
        for batch in batches:
            (nodes, roots, weights), k = (batch.column(i).to_numpy() for i in range(3)), batch.column(3).to_pylist()
            nodes = nodes.view(np.uint64)
            to = shard_of(mix64(nodes), shards)
            rows = [(int(t), *_carry(nodes, roots, weights, k, np.flatnonzero(to == t))) for t in np.unique(to)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "m", "k"])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        nodes, roots, weights, k = _carried(held)
        out = []
        for shard, m in zip(asked.shard, asked.m, strict=True):
            want = unpack(m)[0]
            out.append((shard, *_carry(nodes, roots, weights, k, np.searchsorted(nodes, want))))
        del nodes, roots, weights, k
        trim()
        return pd.DataFrame(out, columns=["shard", "m", "k"])

    def with_hubs(lists: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return compare(lists, told, True)

    def with_all(lists: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return compare(lists, told, False)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, weights = (np.concatenate(c) for c in zip(*map(unpack, pdf.m), strict=True))
        found, inverse = np.unique(nodes, return_inverse=True)
        return pd.DataFrame({"node": found.view(np.int64), "w": np.bincount(inverse, weights=weights).astype(np.int64)})

    def compare(lists: pd.DataFrame, told: pd.DataFrame, hubs: bool) -> pd.DataFrame:
        nodes, roots, weights, k = _carried(told)
        out = []
        for m in lists.m:
            of, node, size = unpack(m)
            at = np.searchsorted(nodes, node.view(np.uint64))
            label = roots[at]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
            ends = np.append(start[1:], len(of))
            for i in np.flatnonzero(mixed):
                rows = slice(start[i], ends[i])
                hub = int(np.argmax(weights[at[rows]])) if hubs else None
                out += _cross(node[rows], size[rows], label[rows], [k[x] for x in at[rows]], hub, num, den)
        pairs = np.unique(np.concatenate([*out, np.zeros((0, 2), np.int64)]), axis=0)
        shard = shard_of(mix64(pairs[:, 0].view(np.uint64)), shards)
        del nodes, roots, weights, k, out
        trim()
        return pd.DataFrame([(int(x), pack(pairs[shard == x, 0].view(np.uint64), pairs[shard == x, 1])) for x in np.unique(shard)], columns=["shard", "m"])

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = np.unique(np.concatenate([np.stack([a.view(np.int64), b], axis=1) for a, b in map(unpack, pdf.m)]), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # Rows without an id are found again by a checksum of their text.
    texts = text_or_empty(docs).withColumn("lone", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    first = ws.save(texts.mapInArrow(sign, "doc_id long, lone long, n_shingles long, node long, k binary, shard int, m binary, nodes binary"), "signed")
    signed = first.filter("shard is null")
    rows = ws.save(signed.select("doc_id", "n_shingles", "node"), "rows")
    sketches = ws.save(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.min("lone").alias("lone"), F.first("n_shingles").alias("n"), F.first("k").alias("k")), "sketches")
    ids = sketches.select("node", "id", F.when(F.col("id").isNull(), F.col("lone")).alias("lone"))
    met = ws.save(first.filter("shard is not null").select("shard", "m", "nodes").groupBy("shard").applyInPandas(meet, "kind int, shard int, m binary"), "met")
    ws.drop("signed")
    ws.tidy()
    pairs = ws.save(met.filter("kind = 1").groupBy("shard").applyInPandas(choose, "a long, b long"), "pairs")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that are linked: filtered by sketches, then verified with the sets of the nodes that are left."""
        a, b = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
        near = ws.save(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(may_link, "a long, b long"), f"{name}-near")
        nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct()
        wanted = ids.join(nodes, "node")
        known = texts.select(F.col("doc_id").alias("id"), "text").join(wanted.select("node", "id"), "id")
        others = texts.filter("doc_id IS NULL").select("lone", "text").join(wanted.select("node", "lone"), "lone")
        found = known.select("node", "text").unionByName(others.select("node", "text")).mapInArrow(load, "node long, s binary")
        sets = ws.save(found.dropDuplicates(["node"]), f"{name}-sets")
        ws.tidy()
        a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        found = ws.save(near.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"), name)
        ws.drop(f"{name}-sets")
        ws.tidy()
        return found

    found = links(pairs, "links")
    lists = met.filter("kind = 2").select("shard", "m")
    weights = ws.save(met.filter("kind = 3").groupBy("shard").applyInPandas(weigh, "node long, w long"), "weights")
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def open_pairs(by, name: str) -> DataFrame:
        """Pairs of one list that are not connected and were not verified."""
        rooted = sketches.join(components(found, ws, f"{name}-cc"), "node", "left").join(weights, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("w", F.lit(0)).alias("w"), "k")
        asked, held = lists.mapInArrow(ask, "bucket int, shard int, m binary"), rooted.mapInArrow(bucket, "bucket int, m binary, k binary")
        told = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(answer, "shard int, m binary, k binary")
        seen = lists.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(by, "shard int, m binary")
        return ws.save(seen.groupBy("shard").applyInPandas(once, "a long, b long").join(done, ["a", "b"], "left_anti"), f"{name}-open")

    for by, name in ((with_hubs, "hubs"), (with_all, "rest")):
        pairs = open_pairs(by, name)
        found = ws.save(found.union(links(pairs, name)), f"{name}-found")
        done = done.union(pairs)
    ws.drop("met")
    # Rows that share an id are one document, whatever their sets.
    same = rows.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")
    shared = rows.join(same.select("doc_id", "a"), "doc_id").filter("node is not null").select("a", F.col("node").alias("b"))
    roots = components(found.union(shared), ws, "cc")
    least = ids.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = least.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = ws.save(least.join(smallest, "root").select("node", "component_id"), "components")
    return rows.join(by_node, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id"))).alias("component_id"))


def op9_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark, table(spark, sf_dir, "documents"), Workspace(spark, "op9")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS x(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
