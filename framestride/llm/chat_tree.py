"""Chat formatting as a prefix tree of conversations.

Conversations that begin with the same turns share them: a turn of the tree is the sequence of turns up to it, and it
belongs to the smallest conv_id that passes through it. So each conversation owns the rest of its turns after the last
one it shares with a smaller conv_id, its *chain*, and hangs where that rest begins. The tree is emitted depth-first, a
chain before the chains that hang from it and those that hang deeper before those that hang higher, which is the order
of the chains' paths. Every shared token has one place, a position id counted from the root, and attends to the spans of
the chains above its own.

The template: ``[INST]text[/INST]`` for a user, ``text</s>`` for an assistant, ``[ROLE]role[/ROLE]text</s>`` for any
other role. The five control strings are single ids after the vocabulary of a byte-level BPE, so ids decode exactly. In
roles and texts a control string gets a backslash after its first character (one more where backslashes stand there
already), which is undone by taking one away. The loss mask covers texts of assistants.

Everything but ids is computed on numbers: turns are told apart by hashes, sorted in ranges and scanned over the cuts.
Texts move once, to their place in the tree.

Defined results: null roles and texts are empty; conv_id and turn see :mod:`framestride.llm.turns`; copies and prefixes
of other conversations own no turn, but have a path; an empty table gives empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framestride.llm.turns import KEYS, identified, join_null_safe, ordered
from framestride.operators import series as S
from framestride.operators.series import CHUNK
from framestride.session import stage

USER, ASSISTANT = "user", "assistant"
#: Control strings; the id of each is the vocabulary's size plus its index.
CONTROLS = ("</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
END, INST, INST_END, ROLE, ROLE_END = range(5)
_ESCAPE = re.compile(r"<(?=\\*/s>)|\[(?=\\*/?(?:INST|ROLE)\])")
_UNESCAPE = re.compile(r"<\\(?=\\*/s>)|\[\\(?=\\*/?(?:INST|ROLE)\])")
#: Code points encoded at a time, and turns of a batch of results.
PIECE, BATCH = 1 << 16, 512
NODE = "tree long, chain long, depth long, start long, position long, n_tokens int, loss_from int, loss_to int, shared boolean, ids array<int>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Tree(NamedTuple):
    """``nodes``: one row per turn of the tree with its place, position and ids. ``paths``: one row per conversation with
    the spans of tokens (chain, start, stop) that make it up; all but its own are what its chain attends to."""

    nodes: DataFrame
    paths: DataFrame


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def escape(text: str) -> str:
    """Break control strings in a text."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


class Codec:
    """Formats turns as ids and reads them back."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.model = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1
        self.bytes = [b""] * self.first + [c.encode() for c in CONTROLS]
        for piece, i in ranks.items():
            self.bytes[i] = piece

    def _text(self, text: str) -> np.ndarray:
        text = escape(text)
        parts = [self.model.encode_to_numpy(text[k : k + PIECE], disallowed_special=()) for k in range(0, len(text), PIECE)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn and the range of them under the loss mask."""
        body = self._text(text)
        mark = [np.array([self.first + k], np.int32) for k in range(len(CONTROLS))]
        if role == USER:
            return np.concatenate([mark[INST], body, mark[INST_END]]), 0, 0
        if role == ASSISTANT:
            return np.concatenate([body, mark[END]]), 0, len(body)
        return np.concatenate([mark[ROLE], self._text(role), mark[ROLE_END], body, mark[END]]), 0, 0

    def decode(self, ids) -> str:
        known = self.bytes
        return b"".join([known[i] for i in ids]).decode()



def read(shown: str) -> tuple[str, str]:
    """Role and text of a formatted turn; no text holds a control string."""
    if shown.startswith(CONTROLS[INST]):
        return USER, unescape(shown[len(CONTROLS[INST]) : -len(CONTROLS[INST_END])])
    shown = shown[: -len(CONTROLS[END])]
    if shown.startswith(CONTROLS[ROLE]):
        role, text = shown[len(CONTROLS[ROLE]) :].split(CONTROLS[ROLE_END], 1)
        return unescape(role), unescape(text)
    return ASSISTANT, unescape(shown)


@cache
def codec(path: str) -> Codec:
    """One codec per process and vocabulary."""
    return Codec(path)


def _sizes(rows: DataFrame, path: str) -> DataFrame:
    """``KEYS`` and the number of ids of each turn."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in batches:
            sizes = [len(known.turn(role.as_py(), text.as_py())[0]) for role, text in zip(batch.column(2), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sizes, pa.int64())], [*KEYS, "n"])

    return rows.mapInArrow(count, "conv_id long, turn long, role string, h1 long, h2 long, n long")


def _xor(name: str, seed: int) -> S.Scan:
    """Running exclusive or of a hash of position and turn: the same only for the same turns so far."""
    value = F.xxhash64(F.lit(seed), "k", "role", "h1", "h2")
    return S.Scan(
        name,
        lambda w: F.bit_xor(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda o: F.bit_xor(value),
        lambda s, w: F.bit_xor(s).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))),
    )


def _owned(sizes: DataFrame) -> DataFrame:
    """Every turn with its position ``k``, the ids of the conversation up to it (``upto``), and the owner of its place."""
    turns = S.scan(ordered(sizes), ["conv_id"], KEYS[1:], [S.position("k")], chunked=True)
    turns = stage(S.scan(turns, ["conv_id"], "k", [_xor("p1", 1), _xor("p2", 2), S.running_sum("upto", "n")], chunked=True).drop(CHUNK))
    places = turns.groupBy("k", "p1", "p2").agg(F.min(F.struct("conv_id")).alias("first"), F.count(F.lit(1)).alias("_n"))
    joined = turns.join(places.where("_n > 1").drop("_n"), ["k", "p1", "p2"], "left")
    owner = F.coalesce("first", F.struct("conv_id"))["conv_id"]
    return stage(joined.select(*KEYS, "k", "n", "upto", owner.alias("chain"), F.col("first").isNotNull().alias("shared")))


def _attached(rows: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """Nodes with their ids: turns and nodes of equal ``KEYS`` meet in order, the texts first."""
    place = F.struct("tree", "chain", "depth", "start", "position", "shared").alias("node")
    both = rows.select(*KEYS, F.lit(0).alias("kind"), "text").unionByName(nodes.select(*KEYS, F.lit(1).alias("kind"), place), allowMissingColumns=True)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        role = text = ids = None
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    role, text, ids = row["role"], row["text"], None
                    continue
                ids = known.turn(role, text) if ids is None else ids
                held.append(row["node"] | {"n_tokens": len(ids[0]), "loss_from": ids[1], "loss_to": ids[2], "ids": ids[0]})
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return both.repartition(*KEYS).sortWithinPartitions(*KEYS, "kind").mapInArrow(attach, NODE)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"depth": pa.int64(), "n_tokens": pa.int32(), "loss_from": pa.int32(), "loss_to": pa.int32(), "shared": pa.bool_(), "ids": pa.list_(pa.int32())}
    names = ["tree", "chain", "depth", "start", "position", "n_tokens", "loss_from", "loss_to", "shared", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.int64())) for c in names], names)


def tree(conversations: DataFrame, path: str | None = None) -> Tree:
    """The prefix tree of all conversations."""
    path = path or vocabulary_path()
    rows = identified(conversations, "")
    turns = _owned(stage(_sizes(rows, path)))
    legs = turns.groupBy("conv_id", "chain").agg(F.min(F.col("upto") - F.col("n")).alias("begin"), F.max("upto").alias("stop"))
    # The legs of a conversation are the chains on its way from the root: there are fewer of them than turns it shares.
    routes = stage(legs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("begin", "chain", "stop"))).alias("legs")))
    own = F.element_at("legs", -1)
    chains = routes.where(own["chain"].eqNullSafe(F.col("conv_id"))).select(
        "conv_id",
        F.transform("legs", lambda leg: F.struct((-leg["begin"]).alias("depth"), leg["chain"].alias("chain"))).alias("key"),
        own["begin"].alias("begin"),
        (own["stop"] - own["begin"]).alias("size"),
    )
    placed = stage(chains.repartitionByRange("key").withColumn(CHUNK, F.spark_partition_id().cast("long")))
    placed = S.scan(placed, [], "key", [S.running_sum("end", "size")], chunked=True)
    placed = stage(placed.select("conv_id", F.col("key")[0]["chain"].alias("tree"), "begin", (F.col("end") - F.col("size")).alias("first")))

    legs = routes.select("conv_id", F.posexplode("legs").alias("at", "leg")).select("conv_id", "at", "leg.chain", F.expr("leg.stop - leg.begin").alias("size"))
    spans = join_null_safe(legs, placed.withColumnsRenamed({"conv_id": "chain"}), ["chain"])
    span = F.struct("at", "chain", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))
    paths = spans.groupBy("conv_id").agg(F.max("tree").alias("tree"), F.array_sort(F.collect_list(span)).alias("spans"))
    paths = paths.select("conv_id", "tree", F.transform("spans", lambda s: F.struct(s["chain"].alias("chain"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))

    nodes = join_null_safe(turns.where("chain <=> conv_id"), placed, ["conv_id"])
    position = F.col("upto") - F.col("n")
    nodes = nodes.select(*KEYS, "tree", "chain", F.col("k").alias("depth"), (F.col("first") + position - F.col("begin")).alias("start"), position.alias("position"), "shared")
    return Tree(stage(_attached(rows, nodes, path)), paths)


def write(nodes: DataFrame, folder: str) -> None:
    """Write the nodes as files in depth-first order."""
    nodes.repartitionByRange("start").sortWithinPartitions("start").write.mode("overwrite").parquet(folder)


def conversations_of(made: Tree) -> DataFrame:
    """The nodes of every conversation, from its spans: conv_id, position, loss range and ids."""
    node = ["position", "loss_from", "loss_to", "ids"]
    own = made.nodes.select(F.col("chain").alias("conv_id"), *node)
    above = made.paths.select("conv_id", F.explode("spans").alias("span")).where("not (span.chain <=> conv_id)").select("conv_id", "span.chain", "span.stop")
    shared = join_null_safe(above, made.nodes.where("shared").select("chain", "start", *node), ["chain"]).where("start < stop")
    return own.union(shared.select("conv_id", *node))


def read_back(made: Tree, path: str | None = None) -> DataFrame:
    """Digests of every conversation from its ids alone: turns, text under the loss mask, formatted length.

    A digest is made in order, so one task reads a conversation, a turn at a time.
    """
    path = path or vocabulary_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        now = None
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(row["conv_id"])
                now.add(known, row["ids"], row["loss_from"], row["loss_to"])
            if len(done) >= BATCH:
                yield _digests(done)
                done = []
        if now is not None:
            yield _digests([*done, now.row()])

    return conversations_of(made).repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(digest, DIGEST)


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, known: Codec, ids: list[int], start: int, stop: int) -> None:
        shown = known.decode(ids)
        role, text = read(shown)
        self.turns += 1
        self.chars += len(shown)
        self.all.update(f"{role}\n{text}\n".encode())
        if stop > start:
            part = unescape(known.decode(ids[start:stop]))
            self.loss_chars += len(part)
            self.loss.update(part.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
