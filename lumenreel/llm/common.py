"""Shared pieces: reading tables, the shared folder, packed arrays for shuffles."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of its own (tests); on a
    cluster the setting is required.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = getattr(spark.sparkContext, "_lumenreel_dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lumenreel-")
        spark.sparkContext._lumenreel_dir = found
    return found


#: Most bytes of one Arrow batch between Spark and Python: executors keep several of them outside the heap.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless it has a smaller bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that a worker no longer uses back to the machine: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


class Workspace:
    """Tables and files of one job under the shared folder.

    A written table cuts lineage and survives lost executors. Everything is
    removed at interpreter exit, or by ``drop`` as soon as it is not needed.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quiet_drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def mkdir(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return self.path(name)

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let go of finished shuffles: executors keep their files until the driver has collected its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _quiet_drop(self) -> None:
        if self.root.startswith("file:"):
            import shutil

            shutil.rmtree(local_path(self.root), ignore_errors=True)


def ordered(df: DataFrame, ws: Workspace, name: str, *by: Column, running: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with the place ``at`` (from 0) of each row in the order ``by``, and the number of rows.

    With ``running``, ``before`` is the sum of that column over all rows before. One
    sort by ranges, written once; only counts and sums of each range come to the
    driver. Equal rows stand in any order.
    """
    fields = df.schema.fieldNames()

    def place(batches):
        from pyspark import TaskContext

        part, at, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            size = batch.column(fields.index(running)).to_numpy(zero_copy_only=False).astype(np.int64) if running else np.zeros(n, np.int64)
            upto = total + np.cumsum(size)
            columns = [*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), pa.array(upto - size), pa.array(upto)]
            yield pa.RecordBatch.from_arrays(columns, [*fields, "_part", "at", "before", "_upto"])
            at, total = at + n, int(upto[-1]) if n else total

    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("_part", "at", "before", "_upto"))])
    placed = ws.save(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(place, schema), name)
    starts, n, total = [], 0, 0
    for row in placed.groupBy("_part").agg(F.count("*").alias("n"), F.max("_upto").alias("upto")).orderBy("_part").collect():
        starts.append((row["_part"], n, total))
        n, total = n + row["n"], total + row["upto"]
    first = df.sparkSession.createDataFrame(starts, "_part long, _rows long, _sum long")
    joined = placed.join(F.broadcast(first), "_part").withColumns({"at": F.col("at") + F.col("_rows"), "before": F.col("before") + F.col("_sum")})
    return joined.select(*fields, "at", *(["before"] if running else [])), n


def local_path(uri: str) -> str:
    """Path of a shared file as tasks can open it (a mounted shared folder)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: model and block files need a shared folder that is mounted, as file:/...")
    return uri


def write_file(uri: str, data: bytes) -> None:
    """Write whole or not at all, so that a retried task leaves the same file."""
    import os

    path = local_path(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, the first one sorted, as a small byte string.

    Each column is stored as byte planes (the first one as differences), which
    zlib shrinks well.
    """
    out = [np.int64(len(columns[0])).tobytes()]
    for i, col in enumerate(columns):
        col = np.ascontiguousarray(col)
        if i == 0:
            col = np.diff(col, prepend=col.dtype.type(0))
        planes = col.view(np.uint8).reshape(len(col), col.dtype.itemsize).T
        body = zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)
        out += [col.dtype.str.encode().ljust(8), np.int64(len(body)).tobytes(), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, columns = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    while at < len(data):
        dtype = np.dtype(data[at : at + 8].decode().strip())
        size = int(np.frombuffer(data[at + 8 : at + 16], np.int64)[0])
        planes = np.frombuffer(zlib.decompress(data[at + 16 : at + 16 + size]), np.uint8)
        col = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
        columns.append(np.cumsum(col, dtype=dtype) if not columns else col)
        at += 16 + size
    return columns


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the upper 32 bits of a hash, so that shards are ranges of it."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def n_shards(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
