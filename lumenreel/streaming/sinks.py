"""Listings and ledgers as streams: micro-batches through the same operators as batch jobs.

State is the stored snapshot itself, in versioned folders; a batch writes a new
version named by its id, so that a batch that is run again replaces its own
output and readers always see a whole version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenreel.operators.relational import keep_first
from lumenreel.operators.snapshots import insert_ignore, upsert


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v") and done(s))


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version of a stored snapshot, or the newest before a batch."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column | str], reset: dict[str, Column] | None = None) -> StreamingQuery:
    """Keeps a snapshot of a stream of rows: each batch goes over the version before it, the first row of a key counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = keep_first(batch, keys, order)
        stored = latest(batch.sparkSession, path, batch_id)
        if stored is None:
            out = rows.withColumns(reset or {})
        else:
            out = upsert(stored, rows, keys, reset=reset)
        out.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column | str]) -> StreamingQuery:
    """Keeps the first delivery of each key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = latest(batch.sparkSession, path, batch_id)
        out = keep_first(batch, keys, order) if stored is None else insert_ignore(stored, batch, keys, order)
        out.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by type and hour with a watermark; a streaming extension of the grouped counts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
