"""Sessions, and where iterative operators cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lumenreel", **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` adds settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder ``spark.checkpoint.dir``; only a local master gets one of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lumenreel-checkpoints-"))
    return df.checkpoint()
