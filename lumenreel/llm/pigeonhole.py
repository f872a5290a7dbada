"""Operator 2: cosine near-duplicates of vectors by a subspace pigeonhole join.

Unit vectors within a squared distance d are rotated by one random orthogonal
matrix and split into blocks of coordinates. In some block two such vectors are
within that block's share of d. Each block is a range join of its own: vectors
are sorted by cells of a grid over its first coordinates and cut into pieces, and
two pieces meet if the boxes around their block's coordinates are within the
block's radius, so every close pair meets exactly once. A pair counts in the
first block whose budget it keeps, which makes the union of candidates disjoint,
and is then verified by its cosine in double precision.

Vectors are written once, to files in the shared folder; a block sorts its own
coordinates only, and a meeting reads the two pieces' coordinates, and vectors
only of rows that have a candidate. Blocks follow one another and their files go
with them, so disk grows with the input whatever the number of meetings. Tasks
send on counts by vector and a spanning forest of the links, not the links. Equal
vectors fold into one first, by a digest of 128 bits.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different length never
link; rows that share an id are one vector if equal, otherwise both are compared
and share a component; rows without an id take no part and are returned with
component null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, local_path, n_shards, table, write_file
from lumenreel.llm.components import components

COSINE, BLOCKS, SEED, PIECE = 0.95, 4, 2, 1024
#: Sums of matrix products may differ by their shapes; what is nearer than this to a bound is summed anew in a fixed order.
EDGE = 1e-9
#: Single precision decides only what is further from a budget than this.
ROUGH = 1e-5
#: Bytes of vectors held before they are written, and rows that are read together.
HELD, ROWS = 16 << 20, 1 << 14


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def in_order(terms) -> np.ndarray:
    """Sums in the order of the terms."""
    total = 0.0
    for t in terms:
        total = total + t
    return total


class Subspaces:
    """Blocks of the rotated coordinates of vectors of one length, with their budgets and grids."""

    def __init__(self, dim: int, cosine: float, blocks: int):
        self.q, many = rotation(dim), min(blocks, dim)
        self.edges = np.linspace(0, dim, many + 1).astype(int)
        # Squared distance of unit vectors at the threshold, shared by the number of coordinates.
        self.budgets = (2 - 2 * cosine) * np.diff(self.edges) / dim * (1 + 1e-9)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1)[:, None]) @ self.q

    def apart(self, x: np.ndarray, x2: np.ndarray, k: int) -> np.ndarray:
        """Squared distances of vectors row by row in one block, summed in order: the same among any others."""
        lo, hi = self.edges[k], self.edges[k + 1]
        unit, unit2 = x / np.linalg.norm(x, axis=1)[:, None], x2 / np.linalg.norm(x2, axis=1)[:, None]
        turned = in_order((unit[:, t, None] - unit2[:, t, None]) * self.q[t, lo:hi] for t in range(x.shape[1]))
        return in_order(turned[:, t] ** 2 for t in range(hi - lo))

    def cells(self, y: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row of a block's coordinates in a grid of about as many cells as there are pieces, and the next coordinate."""
        axes = min(y.shape[1], 1 if pieces < 8 else 2 if pieces < 64 else 3 if pieces < 2000 else 4)
        slabs = max(1, int(np.ceil(pieces ** (1 / axes))))
        # A coordinate of a unit vector has the deviation 1 / sqrt(dim), so slabs by a logistic curve hold about equally many.
        share = 1 / (1 + np.exp(-1.702 * y[:, :axes] * np.sqrt(self.q.shape[0])))
        slab = np.minimum((share * slabs).astype(np.int64), slabs - 1)
        return slab @ slabs ** np.arange(axes)[::-1], y[:, min(axes, y.shape[1] - 1)]


def vectors(rows: DataFrame, whole: bool) -> DataFrame:
    """Of each usable vector its id and digest (h, h2), with ``whole`` also dim and components as bytes, single where that is exact.

    Vectors are scaled by a power of two, which changes no cosine, so that their lengths neither vanish nor overflow.
    """

    def read(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)  # null components: NaN
            lengths = np.diff(offsets)
            usable = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid()) & (lengths > 0)
            number = ids.fill_null(0).to_numpy()
            for d in np.unique(lengths[usable]).tolist():
                at = np.flatnonzero(usable & (lengths == d))
                x = values[offsets[at][:, None] + np.arange(d)].astype(float)
                ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[ok], x[ok]
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) + 0.0
                h = np.frombuffer(b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in x), np.int64).reshape(-1, 2)
                columns = [pa.array(number[at]), pa.array(h[:, 0]), pa.array(h[:, 1])]
                if whole:
                    small = x.astype(np.float32)
                    single = (small == x).all(axis=1).tolist()
                    columns += [pa.array([d] * len(at), pa.int32()), pa.array([(s if one else v).tobytes() for s, v, one in zip(small, x, single, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "h", "h2", "dim", "v"][: len(columns)])

    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).mapInArrow(read, "vec_id long, h long, h2 long" + ", dim int, v binary" * whole)


def keep_vectors(unique: DataFrame, folder: str) -> DataFrame:
    """Write ``unique(h, h2, rep, n, dim, v)`` to files of one length and precision each; returns h, h2, rep, n, dim and loc (file and row)."""

    def write(batches):
        from pyspark import TaskContext

        first, files, held, size = TaskContext.get().partitionId() << 16, 0, {}, 0

        def flush():
            nonlocal files
            for (d, width), groups in sorted(held.items()):
                v, *columns = (b"".join(c) if k == 0 else np.concatenate(c) for k, c in enumerate(zip(*groups, strict=True)))
                file, many = first + files, len(columns[0])
                files += 1
                write_file(f"{folder}/{file}", np.array([d, width, many], np.int64).tobytes() + columns[2].tobytes() + columns[3].tobytes() + v)
                loc = (file << 24) + np.arange(many)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([d] * many, pa.int32()), pa.array(loc)], names=["h", "h2", "rep", "n", "dim", "loc"])
            held.clear()

        for batch in batches:
            *columns, dims, v = batch.columns
            columns, dims, v = [c.to_numpy() for c in columns], dims.to_numpy(), v.to_pylist()
            widths = np.fromiter(map(len, v), np.int64, len(v)) // dims
            for d, width in sorted(set(zip(dims.tolist(), widths.tolist(), strict=True))):
                at = np.flatnonzero((dims == d) & (widths == width))
                held.setdefault((d, width), []).append((b"".join(v[i] for i in at), *(c[at] for c in columns)))
            size += sum(map(len, v))
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    return unique.select("h", "h2", "rep", "n", "dim", "v").mapInArrow(write, "h long, h2 long, rep long, n long, dim int, loc long")


class Kept:
    """Vectors in the files of ``keep_vectors``."""

    def __init__(self, folder: str):
        self.folder, self.opened = local_path(folder), {}

    def file(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rep, n and components of a file's rows, mapped into memory."""
        if number not in self.opened:
            if len(self.opened) > 64:
                self.opened.clear()
            b = np.memmap(f"{self.folder}/{number}", np.uint8, "r")
            d, width, many = b[:24].view(np.int64).tolist()
            rep, n, v = np.split(b[24:], [8 * many, 16 * many])
            self.opened[number] = rep.view(np.int64), n.view(np.int64), v.view(f"f{width}").reshape(many, d)
        return self.opened[number]

    def rows(self, loc: np.ndarray, dim: int) -> np.ndarray:
        files, out = loc >> 24, np.zeros((len(loc), dim))
        for f in np.unique(files).tolist():
            at = np.flatnonzero(files == f)
            out[at] = self.file(f)[2][loc[at] & 0xFFFFFF]
        return out


class Pieces:
    """Pieces of one block, as its layout wrote them: boxes of all, coordinates when asked for."""

    def __init__(self, listed: str, folder: str):
        import pyarrow.parquet as pq

        of = pq.read_table(local_path(listed)).sort_by([("dim", "ascending"), ("file", "ascending"), ("start", "ascending")])
        self.folder, self.opened = local_path(folder), {}
        self.dim, self.file, self.start, self.many = (of[c].to_numpy() for c in ("dim", "file", "start", "many"))
        self.box = [of[c].to_pylist() for c in ("low", "high")]
        self.place = {k: i for i, k in enumerate(zip(self.file.tolist(), self.start.tolist(), strict=True))}
        self.boxes: dict[int, tuple] = {}

    def of_dim(self, d: int) -> tuple:
        """First place of a length, and the boxes of its pieces."""
        if d not in self.boxes:
            at = np.flatnonzero(self.dim == d)
            self.boxes[d] = int(at[0]), *(np.frombuffer(b"".join(side[i] for i in at), np.float32).reshape(len(at), -1) for side in self.box)
        return self.boxes[d]

    def read(self, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A piece's coordinates; its loc, rep and n."""
        f, many = int(self.file[i]), int(self.many[i])
        if f not in self.opened:
            if len(self.opened) > 256:
                self.close()
            self.opened[f] = os.open(f"{self.folder}/{f}", os.O_RDONLY)
        raw = os.pread(self.opened[f], many * (24 + 4 * width), int(self.start[i]))
        numbers = np.frombuffer(raw[4 * many * width :], np.int64).reshape(3, many)
        return np.frombuffer(raw, np.float32, many * width).reshape(many, width), numbers

    def close(self) -> None:
        for fd in self.opened.values():
            os.close(fd)
        self.opened.clear()

    def partners(self, i: int, budget: float) -> np.ndarray:
        """Places of the pieces that this one is to meet, each pair of pieces once and evenly dealt, where boxes are near enough."""
        first, low, high = self.of_dim(int(self.dim[i]))
        me, many = i - first, len(low)
        ahead = (np.arange(many) - me) % many * 2
        turn = (ahead < many) | ((ahead == many) & (np.arange(many) > me))
        at = np.flatnonzero(turn)
        return first + at[away(low[at], high[at], low[me], high[me]) <= budget + ROUGH]


def away(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Squared distances of boxes, or points, from one box."""
    return (np.maximum(np.maximum(low - high2, low2 - high), 0) ** 2).sum(axis=1)


def near_rows(y: np.ndarray, y2: np.ndarray, budget: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either piece that may be within the budget of a row of the other, in single precision with room for its errors."""
    rows, rows2 = np.arange(len(y)), np.arange(len(y2))
    if not same:
        rows = np.flatnonzero(away(y, y, y2.min(axis=0), y2.max(axis=0)) <= budget + ROUGH)
        rows2 = np.flatnonzero(away(y2, y2, y.min(axis=0), y.max(axis=0)) <= budget + ROUGH)
        if not len(rows) or not len(rows2):
            return rows[:0], rows2[:0]
    a, c = y[rows], y2[rows2]
    a = np.concatenate([-2 * a, (a**2).sum(axis=1)[:, None], np.ones((len(a), 1), np.float32)], axis=1)
    c = np.concatenate([c, np.ones((len(c), 1), np.float32), (c**2).sum(axis=1)[:, None]], axis=1).T
    hit, hit2 = np.zeros(len(rows), bool), np.zeros(len(rows2), bool)
    for at in range(0, len(rows), 256):
        apart = a[at : at + 256] @ c
        if same:
            apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = 9
        if apart.min() <= budget + ROUGH:
            near = apart <= budget + ROUGH
            hit[at : at + 256] = near.any(axis=1)
            hit2 |= near.any(axis=0)
    return rows[hit], rows2[hit2]


def links_in(own: tuple, met: tuple, b: int, sub: Subspaces, cosine: float, same: bool, step: int = 256):
    """Of two pieces that meet: for each side the count added by the other, and a spanning forest of the links."""
    (ids, n, x, y), (ids2, n2, x2, y2) = own, met
    # Numbers of nodes: own first, then met; the same piece shares numbers.
    base = 0 if same else len(ids)
    all_ids = ids if same else np.concatenate([ids, ids2])
    label, added = np.arange(len(all_ids)), np.zeros(len(all_ids), np.int64)
    norms, norms2 = np.linalg.norm(x, axis=1), np.linalg.norm(x2, axis=1)

    def table(rows, k):
        lo, hi = sub.edges[k], sub.edges[k + 1]
        a, c = y[rows, lo:hi], y2[:, lo:hi]
        return (a**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (a @ c.T)

    def within(rows, k, i, j, apart):
        """Whether pairs keep a block's budget, the same whatever they are looked at with."""
        near, own = apart <= sub.budgets[k], x[rows]
        edge = np.flatnonzero(np.abs(apart - sub.budgets[k]) < EDGE)
        for some in np.array_split(edge, max(1, len(edge) >> 12)) if len(edge) else ():
            near[some] = sub.apart(own[i[some]], x2[j[some]], k) <= sub.budgets[k]
        return near

    def linked(rows, i, j):
        """Whether pairs reach the cosine."""
        least, found, own = cosine * norms[rows][i] * norms2[j], np.zeros(len(i), bool), x[rows]
        product = own @ x2.T if len(i) > 4 * step else None
        for at in range(0, len(i), 1 << 16):
            p, q, bound = i[at : at + (1 << 16)], j[at : at + (1 << 16)], least[at : at + (1 << 16)]
            dots = product[p, q] if product is not None else (own[p] * x2[q]).sum(axis=1)
            ok, edge = dots >= bound, np.flatnonzero(np.abs(dots - bound) < EDGE * bound)
            if len(edge):
                ok[edge] = in_order(own[p[edge], t] * x2[q[edge], t] for t in range(x.shape[1])) >= bound[edge]
            found[at : at + (1 << 16)] = ok
        return found

    for at in range(0, len(ids), step):
        rows = slice(at, at + step)
        apart = table(rows, b)
        near = apart <= sub.budgets[b] + EDGE
        if same:
            near &= np.arange(len(ids2))[None, :] > np.arange(len(ids))[rows, None]
        i, j = np.nonzero(near)
        keep = within(rows, b, i, j, apart[i, j])
        i, j = i[keep], j[keep]
        for k in range(b):
            if not len(i):
                break
            keep = ~within(rows, k, i, j, table(rows, k)[i, j])
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        ok = linked(rows, i, j)
        i, j = i[ok] + at, j[ok]
        if not len(i):
            continue
        added[: len(ids)] += np.bincount(i, weights=n2[j], minlength=len(ids)).astype(np.int64)[: len(ids)]
        added[base : base + len(ids2)] += np.bincount(j, weights=n[i], minlength=len(ids2)).astype(np.int64)
        j = j + base
        while True:  # labels only fall; every node points to one in its component
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (before == label).all():
                break
    for _ in range(64):
        label = label[label]
    hit = np.flatnonzero(added)
    return all_ids[hit], added[hit], all_ids[label[hit]]


def lay_out(manifest: DataFrame, ws: Workspace, b: int, sizes: dict[int, int], cosine: float, blocks: int, piece: int) -> DataFrame:
    """Pieces of block ``b``: its coordinates sorted by cell, in files; dim, file, start, many and the box of each."""
    kept_in, folder = ws.path("kept"), ws.mkdir(f"block{b}")

    def coordinates(batches):
        kept = Kept(kept_in)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rep, n, v = kept.file(file)
                d = v.shape[1]
                sub = Subspaces(d, cosine, blocks)
                for at in range(0, len(rep) if b < len(sub.budgets) else 0, ROWS):
                    y = sub.rotate(v[at : at + ROWS].astype(float))[:, sub.edges[b] : sub.edges[b + 1]]
                    cell, tie = sub.cells(y, -(-sizes[d] // piece))
                    loc, small = (file << 24) + np.arange(at, at + len(y)), np.ascontiguousarray(y, np.float32)
                    row = 4 * small.shape[1]
                    y_ = pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer((row * np.arange(len(y) + 1)).astype(np.int32)), pa.py_buffer(small)])
                    columns = [pa.array(np.full(len(y), d, np.int32)), pa.array(cell), pa.array(tie), pa.array(loc), pa.array(rep[at : at + ROWS]), pa.array(n[at : at + ROWS]), y_]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "tie", "loc", "rep", "n", "y"])

    def write(batches):
        from pyspark import TaskContext

        file, start = TaskContext.get().partitionId(), 0
        path = f"{local_path(folder)}/{file}"
        part = f"{path}.{uuid.uuid4().hex}"
        names = ["dim", "file", "start", "many", "low", "high"]
        held: list[tuple] = []

        def cut(out, rows: int):
            """Take that many rows off what is held."""
            nonlocal held, start
            d = held[0][0]
            y, numbers = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held], axis=1)
            held = [(d, y[rows:], numbers[:, rows:])] if rows < len(y) else []
            y, numbers = y[:rows], np.ascontiguousarray(numbers[:, :rows])
            out.write(y.tobytes() + numbers.tobytes())
            low, high = y.min(axis=0), y.max(axis=0)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            row = pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((d, file, start, rows, low.tobytes(), high.tobytes()), kinds, strict=True)], names=names)
            start += y.nbytes + numbers.nbytes
            return row

        with open(part, "wb") as out:
            for batch in batches:
                dims, y = batch.column(0).to_numpy(), batch.column(6).to_pylist()
                numbers = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)])
                edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo == hi:
                        continue
                    if held and held[0][0] != dims[lo]:
                        yield cut(out, sum(len(h[1]) for h in held))
                    held.append((int(dims[lo]), np.frombuffer(b"".join(y[lo:hi]), np.float32).reshape(hi - lo, -1), numbers[:, lo:hi]))
                    while sum(len(h[1]) for h in held) >= piece:
                        yield cut(out, piece)
            if held:
                yield cut(out, sum(len(h[1]) for h in held))
        os.replace(part, path)

    by = ["dim", "cell", "tie", "loc"]
    rows = manifest.mapInArrow(coordinates, "dim int, cell long, tie double, loc long, rep long, n long, y binary")
    return ws.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(write, "dim int, file long, start long, many long, low binary, high binary"), f"pieces{b}")


def meetings(pieces: DataFrame, ws: Workspace, b: int, cosine: float, blocks: int) -> DataFrame:
    """Of every piece of block ``b`` and those it meets: counts by vector (loc, n), and its id with one of its component's."""
    listed, folder, kept_in = ws.path(f"pieces{b}"), ws.path(f"block{b}"), ws.path("kept")

    def meet(batches):
        every, kept, subs = Pieces(listed, folder), Kept(kept_in), {}

        def side(numbers, rows, sub):
            x = kept.rows(numbers[0, rows], sub.q.shape[0])
            return numbers[0, rows], numbers[2, rows], x, sub.rotate(x)

        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = every.place[file, start]
                d = int(every.dim[i])
                sub = subs.setdefault(d, Subspaces(d, cosine, blocks))
                budget, width = float(sub.budgets[b]), int(sub.edges[b + 1] - sub.edges[b])
                y, numbers = every.read(i, width)
                for j in every.partners(i, budget).tolist():
                    y2, numbers2 = (y, numbers) if i == j else every.read(j, width)
                    rows, rows2 = near_rows(y, y2, budget, i == j)
                    if not len(rows):
                        continue
                    left = side(numbers, rows, sub)
                    loc, n, root = links_in(left, left if i == j else side(numbers2, rows2, sub), b, sub, cosine, i == j)
                    if not len(loc):
                        continue
                    both = np.concatenate([numbers[:2], numbers2[:2]], axis=1)
                    both = both[:, np.argsort(both[0])]
                    id_of = lambda x, both=both: both[1, np.searchsorted(both[0], x)]
                    yield pa.RecordBatch.from_arrays([pa.array(loc), pa.array(n), pa.array(id_of(loc)), pa.array(id_of(root))], names=["loc", "n", "rep", "root"])
        every.close()

    many = pieces.count()
    dealt = pieces.select("file", "start").repartition(max(1, min(many, max(n_shards(ws.spark), many // 16))))
    return ws.save(dealt.mapInArrow(meet, "loc long, n long, rep long, root long"), f"found{b}")


def near_duplicates(spark: SparkSession, rows: DataFrame, ws: Workspace, cosine: float = COSINE, blocks: int = BLOCKS, piece: int = PIECE) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``rows(vec_id, embedding)``."""
    rows = rows.select("vec_id", "embedding")
    ids = ws.save(vectors(rows, False).distinct(), "ids")
    by_key = ids.groupBy("h", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    unique = vectors(rows, True).groupBy("h", "h2").agg(F.first("dim").alias("dim"), F.first("v").alias("v"))
    keys = ws.save(keep_vectors(unique.join(by_key, ["h", "h2"]), ws.mkdir("kept")), "keys")
    ws.tidy()

    # One number for each length of vectors reaches the driver.
    sizes = {r.dim: r["count"] for r in keys.groupBy("dim").count().collect()}
    files = keys.select(F.shiftright("loc", 24).alias("file")).distinct()
    manifest = ws.save(files, "manifest").repartition(n_shards(spark), "file")
    found = spark.createDataFrame([], "loc long, n long, rep long, root long")
    for b in range(max((min(blocks, d) for d in sizes), default=0)):
        pieces = lay_out(manifest, ws, b, sizes, cosine, blocks, piece)
        ws.tidy()
        found = found.union(meetings(pieces, ws, b, cosine, blocks))
        ws.drop(f"block{b}", f"pieces{b}")
    ws.drop("kept")

    by_vector = found.groupBy("loc").agg(F.sum("n").alias("linked"))
    # Ids of equal vectors, and equal ids of different vectors, are connected through the vector's smallest id.
    reps = ids.join(keys, ["h", "h2"]).select("vec_id", "rep", "n", "loc")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(reps.select("vec_id", "rep")), ws)
    smallest = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    linked = reps.join(by_vector, "loc", "left").select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links")).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    by_id = linked.join(roots.join(smallest, "root").select(F.col("node").alias("vec_id"), "component_id"), "vec_id", "left")
    out = rows.select("vec_id").join(by_id, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op2_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(spark, table(spark, sf_dir, "embeddings"), Workspace(spark, "op2"))
    return rows.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
