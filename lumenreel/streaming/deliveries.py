"""Deliver, then persist: a sink by Spark's Python data source whose commit appends to the ledger what was delivered.

Each task notes a key in a file of its own as soon as its delivery is out, and names
the file in its commit message; the commit moves the files into the ledger. A task that
died leaves its notes, and whoever runs next, a retry or the next job, skips what any
note or the ledger holds. So nothing that was delivered and noted is delivered again.

    spark.dataSource.register(Deliveries)
    rows.write.format("deliveries").option("ledger", folder).option("transport", "module:function").mode("append").save()

Rows have ``key``; the transport is called with a row as a dict. The ledger is a folder
that all executors can open.
"""

from __future__ import annotations

import importlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Noted(WriterCommitMessage):
    """A task's file of notes, and how many deliveries it holds."""

    name: str
    count: int


def _folder(ledger: str) -> str:
    if ledger.startswith("file:"):
        return "/" + ledger[5:].lstrip("/")
    if "://" in ledger:
        raise ValueError(f"{ledger}: the ledger needs a shared folder that is mounted, as file:/...")
    return ledger


def _keys(folder: str) -> set[str]:
    """Keys of all notes of a folder; a last line that was cut off while it was written is none."""
    found = set()
    for name in os.listdir(folder) if os.path.isdir(folder) else ():
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            found.update(json.loads(line)["key"] for line in f if line.endswith("\n"))
    return found


class _Writer(DataSourceWriter):
    def __init__(self, ledger: str, transport: str):
        self.sent, self.noted, self.transport = f"{_folder(ledger)}/sent", f"{_folder(ledger)}/noted", transport
        for folder in (self.sent, self.noted):
            os.makedirs(folder, exist_ok=True)

    def _deliver(self) -> Callable[[dict], None]:
        module, _, name = self.transport.partition(":")
        return getattr(importlib.import_module(module), name)

    def write(self, iterator: Iterator[Row]) -> Noted:
        done, deliver, count = _keys(self.sent) | _keys(self.noted), self._deliver(), 0
        name = f"{uuid.uuid4().hex}.jsonl"
        with open(f"{self.noted}/{name}", "a", encoding="utf-8") as notes:
            for row in iterator:
                key = str(row["key"])
                if key in done:
                    continue
                deliver(row.asDict(recursive=True))
                notes.write(json.dumps({"key": key}) + "\n")
                notes.flush()
                os.fsync(notes.fileno())
                done.add(key)
                count += 1
        return Noted(name, count)

    def commit(self, messages: list[Noted | None]) -> None:
        self._settle()

    def abort(self, messages: list[Noted | None]) -> None:
        """What failed tasks delivered is delivered all the same."""
        self._settle()

    def _settle(self) -> None:
        for name in os.listdir(self.noted):
            os.replace(f"{self.noted}/{name}", f"{self.sent}/{name}")


class Deliveries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> StructType:
        raise NotImplementedError("the ledger is read by delivered()")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("deliveries are only appended")
        if "key" not in schema.fieldNames():
            raise ValueError("rows to deliver need a column key")
        return _Writer(self.options["ledger"], self.options["transport"])


def deliver(rows: DataFrame, ledger: str, transport: str) -> None:
    """Deliver rows (with ``key``) that the ledger does not hold, and append them to it."""
    rows.sparkSession.dataSource.register(Deliveries)
    rows.write.format("deliveries").option("ledger", ledger).option("transport", transport).mode("append").save()


def delivered(spark: SparkSession, ledger: str) -> DataFrame:
    """(key) of what was delivered."""
    _Writer(ledger, "")
    return spark.read.schema("key string").json(f"file://{_folder(ledger)}/sent").distinct()
