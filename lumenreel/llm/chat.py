"""Operator 13: conversations as one prefix tree of token ids.

A conversation is a path of turns; conversations with the same initial turns share
them. A turn is written as ``<|role|>text</s>``, and characters that begin a control
string are followed by a backslash wherever they stand inside a role or text, so no
control string can occur there and the original comes back. Each turn's mark, text
and end are encoded on their own, so shared turns have the same ids whatever follows,
and the text of an assistant is a whole interval of ids: its loss interval.

Nodes are digests of the chain of turns. A run is a chain of nodes up to the next
place where paths part or a conversation ends before others go on. Runs sorted by
their path of runs stand depth-first, so places in the stream are a running sum over
one sort by ranges. The output is three tables:

- ``nodes``: node, parent, start (place in the stream), n_tokens, position (of its
  first token: the tokens of its ancestors), ids, loss_from, loss_to (within ids),
  run_start, shared (conversations that hold it); written in order of the stream;
- ``runs``: run_start, run_end, position, ancestors (intervals of the stream that its
  tokens attend to, besides what stands before them in the run itself);
- ``conversations``: conv_id, run_start of its last run.

A run's path has no more entries than the square root of twice the rows: each entry
needs a conversation of its own that reaches that far and turns off or ends there. A
conversation is read in order, a batch at a time, by one task, as its digests are.

Edge cases: null roles and texts are empty; turns without a number come last; rows of
one turn stand by role, then text, and repeated rows are turns of their own; rows
without a conv_id are one conversation; a text of any length is one node; an empty
table gives empty tables; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm import bpe
from lumenreel.llm.common import Workspace, ordered, small_batches, table

OPEN, CLOSE, END, ESCAPE = "<|", "|>", "</s>", "\\"
#: Strings that mean something to this template or to others that read such files.
CONTROL = (OPEN, CLOSE, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = "".join(sorted({s[0] for s in CONTROL} | {ESCAPE}))
_TO_ESCAPE = re.compile(f"([{re.escape(_FIRST)}])")
_TO_UNESCAPE = re.compile(f"([{re.escape(_FIRST)}]){re.escape(ESCAPE)}")

_TURN = "conv string, conv_id long, ord long, node string, parent string, position long, n_tokens long, ids array<int>, loss_from int, loss_to int, ends boolean"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(rf"\1{re.escape(ESCAPE)}", text)


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub(r"\1", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    role, mark, text = formatted.removeprefix(OPEN).partition(CLOSE)
    if not (formatted.startswith(OPEN) and mark and text.endswith(END)):
        raise ValueError(f"no turn: {formatted[:80]!r}")
    return unescape(role), unescape(text[: -len(END)])


@dataclass
class _Conversation:
    """Where a task stands within a conversation."""

    key: str | None = None
    ord: int = 0
    node: str | None = None
    position: int = 0


def _turns(tokenizer: str, trained: str):
    """Rows in order of their conversations to turns with ids, places and digests of the chain so far."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, held = bpe.encoder(tokenizer), _Conversation(), None
        end = np.frombuffer(next(encode([END])), "<i4")
        for batch in batches:
            rows = batch.to_pydict()
            marks = encode([f"{OPEN}{escape(r)}{CLOSE}" for r in rows["role"]])
            texts = encode([escape(t) for t in rows["text"]])
            out = []
            for key, ident, role, text, mark, body in zip(rows["conv"], rows["conv_id"], rows["role"], rows["text"], marks, texts, strict=True):
                if key != at.key:
                    at = _Conversation(key)
                content = "\n".join((at.node or "", str(len(role)), role, text))
                node = hashlib.sha256(content.encode()).hexdigest()[:32]
                mark, body = np.frombuffer(mark, "<i4"), np.frombuffer(body, "<i4")
                ids = np.concatenate([mark, body, end])
                loss = (len(mark), len(mark) + len(body)) if role == trained else (0, 0)
                if held:
                    out.append((*held, held[0] != key))
                held = (key, ident, at.ord, node, at.node, at.position, len(ids), ids, *loss)
                at.ord, at.node, at.position = at.ord + 1, node, at.position + len(ids)
            if out:
                yield _batch(out)
        if held:
            yield _batch([(*held, True)])

    return chain


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, ident, order, node, parent, position, n, ids, lo, hi, ends = zip(*rows, strict=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    columns = [
        pa.array(conv, pa.string()), pa.array(ident, pa.int64()), pa.array(order, pa.int64()), pa.array(node, pa.string()), pa.array(parent, pa.string()),
        pa.array(position, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(ends),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _TURN.split(", ")])


@dataclass
class ChatTree:
    nodes: DataFrame
    runs: DataFrame
    conversations: DataFrame


def _heads(nodes: DataFrame) -> DataFrame:
    """(node): nodes that begin a run, being first turns or behind a place where paths part or a conversation ends."""
    kids = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    parts = nodes.select("node", "ends").join(kids, "node").filter("kids > 1 OR ends").select(F.col("node").alias("parent"))
    return nodes.filter("parent IS NULL").select("node").unionByName(nodes.filter("parent IS NOT NULL").join(parts, "parent").select("node"))


def chat_tree(convs: DataFrame, ws: Workspace, tokenizer: str | None = None, trained: str = "assistant") -> ChatTree:
    """The tables of the tree over ``convs`` (conv_id, turn, role, text); texts of role ``trained`` are under the loss."""
    small_batches(convs.sparkSession)
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    inside = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_last(), "role", "text")
    turns = ws.save(inside.drop("turn").mapInArrow(_turns(tokenizer or bpe.default_tokenizer(), trained), _TURN), "turns")

    own = ["parent", "position", "n_tokens", "ids", "loss_from", "loss_to"]
    nodes = ws.save(turns.groupBy("node").agg(*[F.first(c).alias(c) for c in own], F.max("ends").alias("ends"), F.count("*").alias("shared")), "distinct")
    heads = ws.save(_heads(nodes), "heads")

    steps = turns.select("conv", "conv_id", "ord", "node", "ends").join(heads.withColumn("head", F.lit(True)), "node", "left")
    so_far = Window.partitionBy("conv").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walk = ws.save(steps.withColumn("run", F.last(F.when(F.col("head"), F.col("node")), ignorenulls=True).over(so_far)), "walk")
    begun = walk.filter("head")
    paths = begun.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ord", "node"))).alias("steps"))
    owned = begun.groupBy(F.col("node").alias("run")).agg(F.min("conv").alias("conv"), F.first("ord").alias("ord"))
    path = F.transform(F.filter("steps", lambda s: s.ord <= F.col("ord")), lambda s: s.node)
    path = owned.join(paths, "conv").select("run", path.alias("path"))

    placed = nodes.join(walk.groupBy("node").agg(F.first("run").alias("run")), "node")
    lengths = placed.groupBy("run").agg(F.sum("n_tokens").alias("tokens"), F.min("position").alias("run_position"))
    runs, _ = ordered(lengths.join(path, "run"), ws, "runs", F.col("path"), running="tokens")
    runs = ws.save(runs.select("run", "path", "run_position", F.col("before").alias("run_start"), (F.col("before") + F.col("tokens")).alias("run_end")), "places")

    place = F.col("run_start") + F.col("position") - F.col("run_position")
    stream = placed.drop("ends").join(runs.select("run", "run_start", "run_position"), "run").withColumn("start", place)
    stream = stream.select("node", "parent", "start", "n_tokens", "position", "ids", "loss_from", "loss_to", "run_start", "shared")
    above = runs.select("run", F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("up"))
    spans = above.join(runs.select(F.col("run").alias("up"), F.struct(F.col("run_start").alias("start"), F.col("run_end").alias("end")).alias("span")), "up")
    spans = spans.groupBy("run").agg(F.sort_array(F.collect_list("span")).alias("ancestors"))
    attended = runs.join(spans, "run", "left").withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    last = walk.filter("ends").join(runs.select("run", "run_start"), "run")
    return ChatTree(
        ws.save(stream.repartitionByRange("start").sortWithinPartitions("start"), "nodes"),
        ws.save(attended.select("run_start", "run_end", F.col("run_position").alias("position"), "ancestors"), "attention"),
        ws.save(last.select("conv", "conv_id", "run_start"), "conversations"),
    )


def turn_texts(tree: ChatTree) -> DataFrame:
    """Nodes of each conversation in turn, found by the intervals that its last run attends to: (conv, conv_id, start, ids, loss_from, loss_to)."""
    own = F.array(F.struct(F.col("run_start").alias("start"), F.col("run_end").alias("end")))
    attended = tree.conversations.join(tree.runs, "run_start").select("conv", "conv_id", F.explode(F.concat("ancestors", own)).alias("span"))
    return attended.select("conv", "conv_id", F.col("span.start").alias("run_start")).join(tree.nodes, "run_start").select("conv", "conv_id", "start", "ids", "loss_from", "loss_to")


def _digests(tokenizer: str, schema: str):
    """Nodes in order of their conversations to one row of sums and digests a conversation."""
    names = [c.split()[0] for c in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = bpe.bytes_of_ids(tokenizer), None

        def text(ids: list[int]) -> str:
            return b"".join([words[i] for i in ids]).decode()

        def row(state) -> tuple:
            ident, n, turns, chars, loss, size = state[1:]
            return ident, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            rows, out = batch.to_pydict(), []
            for conv, ident, ids, lo, hi in zip(*(rows[c] for c in ("conv", "conv_id", "ids", "loss_from", "loss_to")), strict=True):
                if at is None or at[0] != conv:
                    out += [row(at)] if at else []
                    at = [conv, ident, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = text(ids)
                role, said = parse_turn(formatted)
                learnt = unescape(text(ids[lo:hi]))
                at[2] += 1
                at[3].update(f"{role}\n{said}\n".encode())
                at[4] += len(learnt)
                at[5].update(learnt.encode())
                at[6] += len(formatted)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], _arrow(schema))
        if at:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(at), strict=True))], _arrow(schema))

    return digest


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def read_back(tree: ChatTree, tokenizer: str | None = None) -> DataFrame:
    """Each conversation's turns, digests and characters, from the ids of the tree alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    inside = turn_texts(tree).repartition("conv").sortWithinPartitions("conv", "start")
    return inside.mapInArrow(_digests(tokenizer or bpe.default_tokenizer(), schema), schema)


def op13_prefix_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    spoken = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", spoken), (-7, 1, "assistant", spoken)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return read_back(chat_tree(convs, Workspace(spark, "op13")))
