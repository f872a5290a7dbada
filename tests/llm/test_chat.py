import hashlib
import random

import pytest

from lumenreel.llm import bpe, chat
from lumenreel.llm.common import Workspace
from tests.llm.oracle import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """What must come back, from the rows alone."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = [t for *_, role, t in turns if role == "assistant"]
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        sizes = sum(len(chat.escape(r)) + len(chat.escape(t)) + len("<||></s>") for *_, r, t in turns)
        out.append((conv, sizes, sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(turns), hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


def tree_of(spark, rows):
    return chat.chat_tree(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "chat"))


def check(spark, rows):
    tree = tree_of(spark, rows)
    back = chat.read_back(tree)
    assert sorted(back.columns) == ["conv_id", "formatted_chars", "loss_chars", "loss_sha256", "n_turns", "turns_sha256"]
    assert rows_of(back) == plain(rows)
    return tree


ODD = ["", "</s>[INST] ok [/INST]", "a\\b<\\c|", "<|assistant|>x</s>", "<|endoftext|>", "é 😀\n\n\t", "\\", "<\\\\", "|>"]


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ODD + ["hi", "yes", "no"]
    rows, kept = [], []
    for conv in range(n):
        turns = list(rng.choice(kept))[: rng.randint(0, 6)] if kept and rng.random() < 0.7 else []
        turns += [(rng.choice(["user", "assistant", "system", None, "a|>b"]), rng.choice([*words, None])) for _ in range(rng.randint(0 if turns else 1, 4))]
        kept.append(turns)
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def test_random_conversations_come_back_and_prefixes_stand_once(spark):
    rows = random_rows(1, 150)
    tree = check(spark, rows)
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(conv, []).append((role or "", text or ""))
    prefixes = {tuple(t[: k + 1]) for t in by.values() for k in range(len(t))}
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    assert len(nodes) == len(prefixes)
    assert sum(r["shared"] for r in nodes.values()) == len(rows)
    # the stream has no gaps, and is depth-first: what stands after a node and deeper than it is below it
    stream = sorted(nodes.values(), key=lambda r: (r["start"], r["n_tokens"]))
    at, path = 0, []
    for r in stream:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"]
        while path and path[-1] != r["parent"]:
            path.pop()
        assert (path[-1] if path else None) == r["parent"]
        assert r["position"] == sum(nodes[p]["n_tokens"] for p in path)
        path.append(r["node"])
        at += r["n_tokens"]


def test_attention_intervals_are_the_ancestors(spark):
    tree = tree_of(spark, random_rows(2, 80))
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    runs = {r["run_start"]: r for r in tree.runs.collect()}
    for r in nodes.values():
        run, seen, up = runs[r["run_start"]], set(), r["parent"]
        while up:
            seen |= set(range(nodes[up]["start"], nodes[up]["start"] + nodes[up]["n_tokens"]))
            up = nodes[up]["parent"]
        attended = {x for a in run["ancestors"] for x in range(a["start"], a["end"])} | set(range(run["run_start"], r["start"]))
        assert attended == seen
        assert len(attended) == r["position"]


def test_loss_is_the_text_of_assistants(spark):
    tree = tree_of(spark, [(1, 0, "user", "q <s>"), (1, 1, "assistant", "an </s> swer"), (2, 0, "user", "q <s>"), (2, 1, "assistant", "other")])
    words = bpe.bytes_of_ids(bpe.default_tokenizer())
    learnt = [chat.unescape(b"".join(words[i] for i in r["ids"][r["loss_from"] : r["loss_to"]]).decode()) for r in tree.nodes.orderBy("start").collect()]
    assert sorted(learnt) == ["", "an </s> swer", "other"]


def test_edges(spark):
    assert check(spark, []).nodes.count() == 0
    check(spark, [(None, None, None, None), (None, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (5, 0, "user", "long " * 40000)])
    wide = spark.createDataFrame([(1, 0, "user", "a", "n", 5)], SCHEMA + ", node string, run long")
    assert chat.chat_tree(wide, Workspace(spark, "chat")).nodes.count() == 1


def test_many_ends_on_one_path(spark):
    turns = [("user", f"t{k}") for k in range(40)]
    rows = [(c, k, *turns[k]) for c in range(40) for k in range(c + 1)]
    tree = check(spark, rows)
    assert tree.nodes.count() == 40 and tree.runs.count() == 40


@pytest.mark.parametrize("text", ODD)
def test_escaping(text):
    inside = chat.escape(text)
    assert chat.unescape(inside) == text
    assert not any(s in inside for s in chat.CONTROL)


def test_query(spark, sf):
    import duckdb

    from lumenreel.llm.registry import QUERIES

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    spoken = "</s>[INST] ok [/INST]"
    assert rows_of(QUERIES["op13_prefix_tree_chat"](spark, sf)) == plain([*rows, (-7, 0, "user", spoken), (-7, 1, "assistant", spoken)])
