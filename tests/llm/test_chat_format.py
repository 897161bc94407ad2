from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalmill.llm import chat_format

TREE = "tree long, node long, parent long, role string, text string, score double"


def read_back(formatted):
    return formatted.select(
        "tree",
        "leaf",
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()


HARD = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "␛", "␛c", "␛e␛n", "<␛cs>", "<<s>s>", "", None, "\n\n",
    "<|im_end|>", "<|im_en", "d|>", "😀 é x", "[INST]" * 50, "<s></s><<SYS>>", "x" * 100_000,
]


def test_round_trip_of_hard_texts(spark):
    roles = ["user", "assistant", "system", None, "a\nb", "<s>"]
    rows = [(c, t, roles[(c + t) % len(roles)], text, "extra") for c in range(3) for t, text in enumerate(HARD)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    found = {r["tree"]: r for r in read_back(chat_format.format_conversations(turns))}
    for c in range(3):
        own = [(role or "", text or "") for conv, _, role, text, _ in rows if conv == c]
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == own
        assert found[c]["loss"] == "".join(text for role, text in own if role == "assistant")


def test_control_strings_stand_only_where_turns_begin_and_end(spark):
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(HARD)], "conv_id long, turn long, role string, text string")
    said = chat_format.format_conversations(turns).first()["formatted"]
    for control in chat_format.CONTROLS:
        wanted = len(HARD) if control in (chat_format.OPEN, chat_format.CLOSE) else 0
        assert said.count(control) == wanted


def test_all_root_to_leaf_paths(spark):
    edges = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4, 7: None, 8: 99}
    rows = [(0, n, p, "user", f"m{n}", float(n)) for n, p in edges.items()] + [(None, 1, None, "user", "no tree", None)]
    messages = spark.createDataFrame(rows, TREE)
    found: dict[tuple, list] = {}
    for r in chat_format.root_to_leaf_paths(messages).collect():
        found.setdefault((r["tree"], r["leaf"]), []).append((r["up"], r["node"]))
    paths = {k: [n for _, n in sorted(v, reverse=True)] for k, v in found.items()}
    assert paths == {(0, 3): [1, 3], (0, 5): [1, 2, 5], (0, 6): [1, 2, 4, 6], (0, 7): [7], (0, 8): [8], (None, 1): [1]}
    best = chat_format.best_branches(chat_format.root_to_leaf_paths(messages), messages, per_tree=2).filter("tree = 0")
    assert [r["leaf"] for r in best.orderBy("branch_rank").collect()] == [8, 7]


def test_long_chain(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", str(t)) for t in range(700)],
                                  "conv_id long, turn long, role string, text string")
    found = read_back(chat_format.format_conversations(turns))
    assert len(found) == 1 and [t["text"] for t in found[0]["turns"]] == [str(t) for t in range(700)]
    assert found[0]["loss"] == "".join(str(t) for t in range(0, 700, 2))


def test_ties_of_branches_go_to_the_smaller_leaf(spark):
    rows = [(0, 1, None, "user", "q", 1.0), (0, 3, 1, "assistant", "b", 2.0), (0, 2, 1, "assistant", "a", 2.0)]
    messages = spark.createDataFrame(rows, TREE)
    best = chat_format.best_branches(chat_format.root_to_leaf_paths(messages), messages)
    assert [r["leaf"] for r in best.orderBy("branch_rank").collect()] == [2, 3]


@pytest.mark.parametrize("more", [[], [(0, 9, None, "user", "root", 0.0)]])
def test_cycles_are_refused(spark, more):
    rows = [(0, 1, 2, "user", "a", 0.0), (0, 2, 1, "user", "b", 0.0), *more]
    with pytest.raises(ValueError, match="cycle"):
        chat_format.root_to_leaf_paths(spark.createDataFrame(rows, TREE))


def test_repeated_and_tied_turns_all_stay(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = read_back(chat_format.format_conversations(turns))
    assert [t["text"] for t in found[0]["turns"]] == ["first", "a", "a", "b"]


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(turns).count() == 0
