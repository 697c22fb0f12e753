import hashlib
import random

import pytest
from pyspark.sql import functions as F

from framestride.llm import chat_tree

ROWS = "conv_id long, turn long, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "[ROLE]x[/ROLE]", "", " ", "<", "[", "\\", "<[INST]/s>", "</s", "é日本\U0001f600\x00\n", "[" + "\\" * 500 + "/INST]"]


def clash(df):
    for c in ("tree", "chain", "start", "stop", "n", "k", "h1", "kind", "_row", "spans", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def random_rows(seed, n):
    """Conversations that share first turns, with prefixes and copies of each other."""
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.randrange(1, 7)):
            role = pick.choice(["user", "assistant", "system", None, "[INST]"]) if pick.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = pick.choice(["hi", "yes", "no"]) if turn < 4 else pick.choice(HARD)
            rows.append((conv if conv else None, turn if pick.random() > 0.05 else None, role, text if pick.random() > 0.05 else None))
    return rows


def sequences(rows):
    """Turns of each conversation, if no two turns of one number differ."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in out.items()}


def expected(turns):
    loss = [t for r, t in turns if r == "assistant"]
    shown = []
    for role, text in turns:
        text, name = chat_tree.escape(text), chat_tree.escape(role)
        shown.append({"user": f"[INST]{text}[/INST]", "assistant": f"{text}</s>"}.get(role, f"[ROLE]{name}[/ROLE]{text}</s>"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, loss)), sha("".join(loss)), sum(map(len, shown))


def test_escapes_are_undone_and_leave_no_control_string():
    pick = random.Random(3)
    for _ in range(3000):
        text = "".join(pick.choice(["<", "[", "\\", "/s>", "/", "INST]", "ROLE]", "x", "</s>"]) for _ in range(pick.randrange(9)))
        kept = chat_tree.escape(text)
        assert chat_tree.unescape(kept) == text and not any(c in kept for c in chat_tree.CONTROLS)
    assert chat_tree.escape("a < b [1] \\n") == "a < b [1] \\n"


@pytest.mark.parametrize("text", [*HARD, " " * 200_000, "a" * 200_000, "ab</s>" * 30_000])
def test_ids_hold_a_turn(text):
    known = chat_tree.codec(chat_tree.vocabulary_path())
    for role in ("user", "assistant", "system", "", "[/ROLE]"):
        ids, start, stop = known.turn(role, text)
        assert chat_tree.read(known.decode(ids.tolist())) == (role, text)
        assert chat_tree.unescape(known.decode(ids[start:stop].tolist())) == (text if role == "assistant" else "")
        assert (ids >= known.first).sum() == {"user": 2, "assistant": 1}.get(role, 3)


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_holds_every_conversation_and_shares_each_first_turn_once(spark, seed):
    rows = [r for r in random_rows(seed, 60) if r[1] is not None] + [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    # Ties are ordered by hashes, so only rows of different roles or texts are compared where they are the same.
    made = chat_tree.tree(clash(spark.createDataFrame(rows, ROWS).repartition(5)))
    turns = sequences(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_back(made).collect()}
    assert got == {c: expected(t) for c, t in turns.items()}

    nodes = made.nodes.orderBy("start").collect()
    prefixes = {tuple(t[: k + 1]) for t in turns.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes)
    # Depth-first: places follow each other, and a walk by positions passes through every turn once.
    assert [n["start"] for n in nodes] == [sum(len(m["ids"]) for m in nodes[:k]) for k in range(len(nodes))]
    spans = {r["conv_id"]: r["spans"] for r in made.paths.collect()}
    stack = []
    for n in nodes:
        while stack and stack[-1]["position"] + stack[-1]["n_tokens"] > n["position"]:
            stack.pop()
        assert n["position"] == sum(m["n_tokens"] for m in stack)
        seen = [p for s in spans[n["chain"]] for p in range(s["start"], min(s["stop"], n["start"]))]
        assert seen == [p for m in stack for p in range(m["start"], m["start"] + m["n_tokens"])]
        stack.append(n)
    assert {n["tree"] for n in nodes} <= {min((c for c in turns if turns[c][0] == t[0]), key=lambda c: (c is not None, c or 0)) for t in turns.values()}


def test_repeated_and_unnumbered_turns(spark):
    rows = [(1, None, "user", "b"), (1, 0, "user", "c"), (1, 0, "user", "c"), (2, None, "user", "b"), (2, 0, "user", "c"), (3, 5, None, None), (None, None, None, None)]
    rows += [(9, 1, "user", "same")] * 50
    made = chat_tree.tree(spark.createDataFrame(rows, ROWS))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_tree.read_back(made).collect()}
    assert got == {c: expected(t) for c, t in sequences(rows).items()}
    assert made.nodes.where("chain = 2").count() == 0 and made.nodes.where("chain = 9").count() == 50


def test_files_are_depth_first(spark, tmp_path):
    made = chat_tree.tree(spark.createDataFrame(random_rows(4, 30), ROWS))
    chat_tree.write(made.nodes, str(tmp_path / "tree"))
    starts = []
    for path in sorted((tmp_path / "tree").glob("*.parquet")):
        starts += [r["start"] for r in spark.read.parquet(str(path)).collect()]
    assert starts == sorted(starts) and len(starts) == made.nodes.count()


def test_no_conversations(spark):
    made = chat_tree.tree(spark.createDataFrame([], ROWS))
    assert made.nodes.count() == made.paths.count() == chat_tree.read_back(made).count() == 0
