"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last keep
the columns of ``documents``, and any others: names that end in two underscores
are the stages' own. Null and empty texts are scored, are no duplicates, hold no
personal data, are not taken by the mix, which takes words, and are packed as
their end id; very long texts go through whole; repeated rows are one after the
second stage; an empty table stays empty. All else is as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import mixing, packing, partenum, pii, quality
from lumenreel.llm.common import Workspace, table

#: Least score of a document that stays; words a shingle and percent of similarity of near-duplicates.
MIN_QUALITY, SHINGLE_WORDS, SIMILARITY = 0.5, 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier, fitted on this stage's input, does not reject."""
    scored = quality.score(spark, docs, *quality.fit(spark, docs, table(spark, sf_dir, "labels")), name="score__")
    return scored.filter(F.col("score__") >= MIN_QUALITY).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of linked documents the one with the smallest id, once.

    Documents without words are no duplicates; rows without an id cannot stand for a group and stay. Of rows that share
    an id, and with it a group, the one that is least in the order of its columns stays, whole.
    """
    classes = partenum.jaccard_classes(spark, docs, Workspace(spark, "dedup"), SHINGLE_WORDS, SIMILARITY, 100)
    kept = classes.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows__"))
    found = docs.join(kept, "doc_id")
    once = found.filter("rows__ = 1").select(docs.columns)
    repeated = found.filter("rows__ > 1").select(docs.columns).groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("r"))
    repeated = repeated.select("doc_id", "r.*").select(docs.columns)
    return once.unionByName(repeated).unionByName(docs.filter("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every span found is replaced by its kind."""
    return pii.redact(docs, Workspace(spark, "redact"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as the mix takes them, a row for each pass; a partly taken one has the words of its blocks."""
    return mixing.mixed_documents(spark, docs, Workspace(spark, "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of token ids and their places in sequences."""
    return packing.pack_documents(spark, docs, Workspace(spark, "pack"))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("pii", redact_pii), ("mix", mix_sources), ("pack", pack_sequences)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
