"""Operator 5: token ids in canonical length-limited Huffman block files.

Global id counts give one code for the corpus; files hold independent blocks of
ids with the bit offset of each block, and are decoded by table lookups, all
blocks of a file in step.

Edge cases: null text counts as empty (only the end id); rows without a doc_id
come first and are given back without one; rows that share a doc_id, repeated
rows too, stand next to each other, by text, each with its own ids; a text of any
length is one document (a file is closed after it); an empty table gives no files
and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import bpe
from lumenreel.llm.common import Workspace, table, text_or_empty, write_file

MAGIC = b"LRHUF2\0\0"
#: Ids in a block, ids after which a file is closed, longest code.
BLOCK, FILE_IDS, MAX_BITS = 1024, 1 << 21, 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Package-merge: optimal code lengths of at most ``max_bits`` for positive counts."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    flags, level = [], leaves
    for i in range(max_bits):
        if i:
            packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaves, packages])
            by = np.argsort(both, kind="stable")
            level, is_leaf = both[by], by < n
        else:
            is_leaf = np.ones(n, bool)
        flags.append(is_leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(flags):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (min(take, len(is_leaf)) - used)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code over ids: shorter codes first, ties by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        by = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[by], lengths[by]
        self.bits = int(self.lengths.max(initial=1))
        codes, code, last = [], 0, 0
        for n in self.lengths.tolist():
            code <<= n - last
            codes.append(code)
            code, last = code + 1, n
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.len_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.len_of[self.ids] = codes, self.lengths
        spans = 1 << (self.bits - self.lengths)
        self.table_id = np.repeat(self.ids, spans)
        self.table_len = np.repeat(self.lengths, spans)
        short = (1 << self.bits) - len(self.table_id)  # only with a single id
        self.table_id = np.pad(self.table_id, (0, short))
        self.table_len = np.pad(self.table_len, (0, short), constant_values=1)
        #: Id and length of the code that begins with some bits, in one number.
        self.entries = (self.table_id.astype(np.int64) << 6) | self.table_len

    def encode(self, ids: np.ndarray, block: int = BLOCK, blocks: int = 128) -> tuple[bytes, np.ndarray]:
        """Bits, and the bit offset of each block; after every so many blocks bits go on at a whole byte."""
        parts, offsets, size = [], [], 0
        for at in range(0, len(ids), block * blocks):
            bits, starts = self._encode(ids[at : at + block * blocks], block)
            parts.append(bits)
            offsets.append(starts + 8 * size)
            size += len(bits)
        return b"".join(parts), np.concatenate([*offsets, np.zeros(0, np.int64)])

    def _encode(self, ids: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
        """As many codes as surely fit are joined to a word of at most 64 bits, and each word goes to two places at most."""
        lens, group = self.len_of[ids], 64 // self.bits
        ends = np.cumsum(lens)
        starts = (ends - lens)[::block]
        if not len(ids):
            return b"", starts
        rest = -len(ids) % group
        codes, sizes = (np.pad(x, (0, rest)).reshape(-1, group).T for x in (self.code_of[ids], lens.astype(np.uint64)))
        word, many = codes[0], sizes[0]
        for code, n in zip(codes[1:], sizes[1:], strict=True):
            word, many = (word << n) | code, many + n
        at = np.cumsum(many) - many
        shift, place = at & np.uint64(63), (at >> np.uint64(6)).astype(np.int64)
        word = word << (np.uint64(64) - many)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out = np.zeros(int(place[-1]) + 2, np.uint64)
        out[place[first]] = np.bitwise_or.reduceat(word >> shift, first)
        out[place[first] + 1] |= np.bitwise_or.reduceat(word << (np.uint64(63) - shift) << np.uint64(1), first)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts

    def decode(self, data: bytes, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        b, size = np.frombuffer(data + b"\0" * 8, np.uint8), (self.bits + 14) // 8
        word = np.zeros(len(b) - 7, np.uint32 if size <= 4 else np.uint64)
        for k in range(size):
            word <<= word.dtype.type(8)
            word |= b[k : len(b) - 7 + k]
        out = np.zeros((block, len(offsets)), np.uint32)
        at, top, mask = offsets.astype(np.int64), 8 * size - self.bits, (1 << self.bits) - 1
        for k in range(min(block, n)):
            peek = (word.take(at >> 3, mode="clip").astype(np.int64) >> (top - (at & 7))) & mask
            entry = self.entries[peek]
            out[k] = entry >> 6
            at += entry & 63
        return out.T.reshape(-1)[:n]


def file_bytes(code: Code, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """Magic; counts; then document ids, which of them are null, their lengths, block offsets and bits, each with its size."""
    ids = np.concatenate(docs)
    bits, offsets = code.encode(ids)
    numbers, null = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8)
    parts = [np.diff(numbers, prepend=0).tobytes(), null.tobytes(), np.array(list(map(len, docs)), "<u8").tobytes(), np.diff(offsets.astype("<i8"), prepend=0).tobytes()]
    parts = [zlib.compress(p, 1) for p in parts] + [bits]
    return MAGIC + struct.pack("<8q", len(docs), len(ids), BLOCK, *map(len, parts)) + b"".join(parts)


def read_file(code: Code, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    _, n, block, *sizes = struct.unpack("<8q", data[8:72])
    at, parts = 72, []
    for s in sizes:
        parts.append(data[at : at + s])
        at += s
    doc_ids, null, lengths, offsets = (np.frombuffer(zlib.decompress(p), d) for p, d in zip(parts, ("<i8", "?", "<u8", "<i8"), strict=False))
    return pa.array(np.cumsum(doc_ids), mask=null), lengths.astype(np.int64), code.decode(parts[4], np.cumsum(offsets), n, block)


def write_token_files(spark: SparkSession, docs: DataFrame, ws: Workspace, tokenizer: str | None = None, end_id: int = bpe.END_ID) -> tuple[DataFrame, Code]:
    """Token files of ``docs(doc_id, text)`` in ascending doc_id order.

    Returns the list of files (``pid``, ``first``, ``n_ids``, ``path``; in the order
    of ``pid`` and ``first``) and the code. One shuffle sorts the texts by range;
    ids are kept once as a table, counted, then encoded where they lie.
    """
    tokenizer = tokenizer or bpe.default_tokenizer()
    narrow = max(bpe.vocabulary_size(tokenizer), end_id + 1) <= 1 << 16
    schema = pa.schema([("pid", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def ids_of(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<u2" if narrow else "<u4")

    def tokenize(batches):
        from pyspark import TaskContext

        pid, seq = TaskContext.get().partitionId(), 0
        for doc_ids, ids in bpe.encode_batches(batches, tokenizer, end_id):
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if narrow else ids
            yield bpe.as_batch(schema, [[pid] * len(ids), list(range(seq, seq + len(ids))), doc_ids, small])
            seq += len(ids)

    # Ranges by id and the beginning of the text, so that rows of one id, or of none, need not be one task's.
    ordered = text_or_empty(docs).repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ids = ws.save(ordered.mapInArrow(tokenize, "pid int, seq long, doc_id long, ids binary"), "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                c = np.bincount(ids_of(b"".join(batch.column(0).slice(at, 256).to_pylist())))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    # At most one row for each id of the vocabulary reaches the driver.
    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    code = Code(np.array([r.id for r in counts], np.int64), code_lengths(np.array([r.n for r in counts], np.int64)))
    folder = ws.mkdir("files")
    made = pa.schema([("pid", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("path", pa.string())])

    def encode(batches):
        held: list = []

        def close():
            pid, first = held[0][:2]
            path = f"{folder}/{pid:06d}-{first:012d}.huf"
            write_file(path, file_bytes(code, [h[2] for h in held], [h[3] for h in held]))
            row = bpe.as_batch(made, [[pid], [first], [sum(len(h[3]) for h in held)], [path]])
            held.clear()
            return row

        for batch in batches:
            for pid, seq, doc_id, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0] != pid or held[-1][1] != seq - 1 or size >= FILE_IDS):
                    yield close()
                if not held:
                    size = 0
                held.append((pid, seq, doc_id, ids_of(x)))
                size += len(held[-1][3])
        if held:
            yield close()

    files = ws.save(ids.mapInArrow(encode, "pid int, first long, n_ids long, path string"), "manifest")
    ws.drop("ids")
    return files, code


def read_token_files(spark: SparkSession, files: DataFrame, code: Code, ws: Workspace) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    # Where each file starts: sums by pid first, so the only ordered sum over all is over range partitions.
    from pyspark.sql import Window

    by_pid = files.groupBy("pid").agg(F.sum("n_ids").alias("n"))
    by_pid = by_pid.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    starts = files.select("pid", "first", (F.sum("n_ids").over(Window.partitionBy("pid").orderBy("first")) - F.col("n_ids")).alias("at")).join(by_pid, "pid")
    starts = starts.select(F.format_string("%06d-%012d.huf", "pid", "first").alias("name"), (F.col("base") + F.col("at")).alias("base"))
    schema = pa.schema([("name", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, lengths, ids = read_file(code, content)
                ends = np.cumsum(lengths)
                crcs = [bpe.crc(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield bpe.as_batch(schema, [[path.rsplit("/", 1)[-1]] * len(doc_ids), doc_ids, ends - lengths, lengths, crcs])

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    stored = spark.read.format("binaryFile").load(ws.path("files")).select("path", "content")
    docs = stored.mapInArrow(decode, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(starts) if files.count() < 10_000 else starts, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "op5")
    files, code = write_token_files(spark, table(spark, sf_dir, "documents"), ws)
    return read_token_files(spark, files, code, ws)
