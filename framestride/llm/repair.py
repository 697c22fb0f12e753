"""Cheapest repair of damaged conversations by an auction for shortest paths.

A repair keeps, re-roles, deletes and inserts turns so that the initials of the roles read ``(s?(ua)+)?``. It is a path
through a lattice of (turns read, state of that pattern); the arcs' costs are integers. The auction holds a price for
each node, at most the arc's cost above the price of the node it leads to, and a path whose arcs meet that bound. At the
end of the path it either raises the price to the least its arcs allow and takes the last step back, or goes on along
the best arc. When the path arrives, the price of its origin is the cost. The prices then show which arcs are tight;
every cheapest path consists of tight arcs, and the one with the ASCII-least letters is traced among them.

A conversation is cut into pieces of ``PIECE`` turns. For one of several pieces, auctions for every pair of states give
its costs from border to border, these are carried back over the borders, and each piece is then solved on its own with
the prices behind it, from every state it may be entered in; a walk over the borders picks. So the auctions of one long
conversation run in many tasks, and no task holds more than a piece.

Defined results: null roles and texts count as one space; a null conv_id is a conversation of its own; turns of equal
number are ordered by role, then by hashes of the texts; an initial is the first character of a role, which may be
empty; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.llm.turns import KEYS, identified, join_null_safe, ordered
from framestride.operators import series as S
from framestride.operators.series import CHUNK
from framestride.session import stage

#: Turns of a piece; solved pieces kept per process; rows of a batch of results.
PIECE, SOLVED, BATCH = 64, 1 << 16, 1024
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation may end in ENDS.
STATES, ENDS = 4, (0.0, math.inf, math.inf, 0.0)
_INITIALS = "uas"
#: The state after a kept turn of an initial, and after a user or assistant turn where one may stand.
_KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)
SOUND, TRUNCATED, FORCED = range(3)
REPAIRED = "conv_id long, position long, edit string, role string, text string"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# The lattice -------------------------------------------------------------------------------------------------------


def code(role: Column, fault: Column) -> Column:
    """What the lattice needs of a turn: its initial and whether it is sound, truncated or to be deleted."""
    initial = F.substring(role, 1, 1)
    number = F.lit(len(_INITIALS))
    for k, letter in enumerate(_INITIALS):
        number = F.when(initial == letter, k).otherwise(number)
    return (number * 3 + fault).cast("int")


def _steps(number: int, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, state after)`` of the arcs that read a turn."""
    initial, fault = (_INITIALS + "?")[number // 3], number % 3
    out = [("D", DELETE, state)]
    if fault != FORCED:
        extra = CUT if fault == TRUNCATED else 0
        if (state, initial) in _KEEPS:
            out.append(("K", KEEP + extra, _KEEPS[state, initial]))
        out.append(("R", REROLE + extra, _NEXT[state]))
    return out


_STEPS = {(number, state): _steps(number, state) for number in range(3 * (len(_INITIALS) + 1)) for state in range(STATES)}


class Lattice:
    """The lattice of a piece. Node ``4 * turns read + state``; the last node stands for what lies behind the piece.

    ``exits`` are the prices behind it by state. Turns may be inserted before each turn of the piece, behind it only
    where the conversation ends: elsewhere that is the next piece's first place.
    """

    def __init__(self, codes: list[int], exits: tuple[float, ...], last: bool):
        n = len(codes)
        self.turns, self.end = n, STATES * (n + 1)
        self.arcs: list[list[tuple[str, float, int]]] = []
        for i in range(n + 1):
            for state in range(STATES):
                arcs = [(letter, cost, STATES * (i + 1) + after) for letter, cost, after in (_STEPS[codes[i], state] if i < n else ())]
                if i < n or last:
                    arcs.append(("I", INSERT, STATES * i + _NEXT[state]))
                if i == n and exits[state] < math.inf:
                    arcs.append(("", exits[state], self.end))
                self.arcs.append(sorted(arcs))
        self.arcs.append([])
        # Nodes from which the end cannot be reached would be raised for ever: they are closed from the start.
        # The rest starts at a price that every way from it costs at least, which no arc contradicts.
        self.price = [math.inf] * self.end + [0.0]
        least = min(exits)
        for i in range(n, -1, -1):
            least += DELETE if i < n and codes[i] % 3 != SOUND else 0
            for _ in range(3):
                for node in range(STATES * i, STATES * (i + 1)):
                    if any(self.price[to] < math.inf for _, _, to in self.arcs[node]):
                        self.price[node] = least

    def auction(self, state: int) -> float:
        """The cost from a state at the piece's start to the end; prices stay for the next auction."""
        price, arcs, path = self.price, self.arcs, [state]
        if price[state] == math.inf:
            return math.inf
        while path[-1] != self.end:
            node = path[-1]
            best, to = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """ASCII-least letters of a cheapest path from a state whose auction is done, and the state at its end."""
        tight = [[(letter, to) for letter, cost, to in arcs if self.price[node] == cost + self.price[to] < math.inf] for node, arcs in enumerate(self.arcs)]
        live = [False] * self.end + [True]
        for i in range(self.turns, -1, -1):
            for _ in range(3):
                for node in range(STATES * i, STATES * (i + 1)):
                    live[node] = live[node] or any(live[to] for _, to in tight[node])
        letters, node = [], state
        while True:
            # A letter leads from a node to one node only, and arcs are sorted by letter.
            letter, to = next((letter, to) for letter, to in tight[node] if live[to])
            if to == self.end:
                return "".join(letters), node % STATES
            letters.append(letter)
            node = to


@lru_cache(SOLVED)
def costs(codes: bytes) -> tuple[float, ...]:
    """Costs of a piece within a conversation, by state before and state behind."""
    out = []
    for behind in range(STATES):
        lattice = Lattice(list(codes), tuple(0.0 if s == behind else math.inf for s in range(STATES)), False)
        out.append([lattice.auction(s) for s in range(STATES)])
    return tuple(out[behind][before] for before in range(STATES) for behind in range(STATES))


@lru_cache(SOLVED)
def solve(codes: bytes, exits: tuple[float, ...], last: bool, states: tuple[int, ...]) -> tuple[tuple[float, str, int], ...]:
    """Cost, letters and state behind, for each state before the piece."""
    # Only differences between the prices behind matter.
    lattice = Lattice(list(codes), exits, last)
    out = []
    for state in states:
        cost = lattice.auction(state)
        out.append((cost, *lattice.trace(state)) if cost < math.inf else (cost, "", state))
    return tuple(out)


# Conversations -----------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: dropped, emptied, without end marks, repeated, or made a user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    fault = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    rows = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def examine(rows: DataFrame) -> DataFrame:
    """Every turn in order (``k``) with its first fault and its code; texts are left behind."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = identified(rows, " ").select(*KEYS, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    turns = S.scan(ordered(stage(rows)), ["conv_id"], KEYS[1:], [S.position("k"), S.lag("before", F.substring("role", 1, 1))], chunked=True)
    turns = stage(turns.drop(CHUNK))
    same = turns.groupBy("conv_id", "role", "h1", "h2").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    turns = join_null_safe(turns, same, ["conv_id", "role", "h1", "h2"], "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("first") < F.col("k"), F.lit(False))
    turns = turns.withColumns({"duplicate": duplicate, "truncated": ~F.col("blank") & ~duplicate & F.col("cut")})
    fault = F.when(F.col("blank") | F.col("duplicate"), FORCED).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    pair = F.concat("before", F.substring("role", 1, 1))
    illegal = (F.col("k") > 0) & ~pair.isin("su", "ua", "au")
    return stage(turns.select(*KEYS, "k", "blank", "duplicate", "truncated", illegal.alias("illegal"), code(F.col("role"), fault).alias("code")))


def _pieces(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each conversation, and its pieces with their codes and the keys of their first turn."""
    ones = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = turns.groupBy("conv_id").agg(gaps, *ones, F.ceil(F.count(F.lit(1)) / PIECE).cast("long").alias("pieces"))
    turns = turns.withColumn("piece", F.floor(F.col("k") / PIECE).cast("long"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("codes")
    pieces = turns.groupBy("conv_id", "piece").agg(codes, F.min_by(F.struct(*KEYS[1:]), "k").alias("first"))
    return counts, join_null_safe(pieces, counts.select("conv_id", "pieces"), ["conv_id"])


def _single(pieces: DataFrame) -> DataFrame:
    """The solution of conversations of one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(bytes(c), ENDS, True, (0,))[0] for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[1] for f in found]), pa.array([int(f[0]) for f in found], pa.int64())], [*batch.schema.names, "letters", "cost"])

    rows = pieces.where("pieces = 1").select("piece", "codes", "conv_id", "first")
    return rows.mapInArrow(run, _schema(rows) + ", letters string, cost long").drop("codes")


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _several(pieces: DataFrame) -> DataFrame:
    """The solution of conversations of several pieces."""

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if last else list(costs(bytes(c))) for c, last in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "costs"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind: tuple[float, ...] = ENDS
        for batch in batches:
            exits = []
            for codes, last, table in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4))):
                behind = ENDS if last else behind
                exits.append(list(behind))
                if last:
                    behind = tuple(c for c, _, _ in solve(bytes(codes), ENDS, True, tuple(range(STATES))))
                else:
                    behind = tuple(min(table[STATES * s + t] + behind[t] for t in range(STATES)) for s in range(STATES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(exits, pa.list_(pa.float64()))], [*batch.schema.names[:4], "exits"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes, last, piece, exits in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                states = (0,) if piece == 0 else tuple(range(STATES))
                low = min(exits)
                solved = solve(bytes(codes), tuple(x - low for x in exits), last, states)
                found.append([{"cost": int(c + low), "letters": letters, "state": s} if c < math.inf else None for c, letters, s in solved])
            kind = pa.list_(pa.struct([("cost", pa.int64()), ("letters", pa.string()), ("state", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, kind)], ["conv_id", "piece", "ways"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for batch in batches:
            letters, cost = [], []
            for piece, ways in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                way = ways[0 if piece == 0 else state]
                letters.append(way["letters"])
                cost.append(way["cost"] if piece == 0 else None)
                state = way["state"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(letters), pa.array(cost, pa.int64())], ["conv_id", "piece", "letters", "cost"])

    rows = pieces.where("pieces > 1").select("conv_id", "codes", F.expr("piece = pieces - 1").alias("last"), "piece")
    costed = rows.mapInArrow(forward, _schema(rows) + ", costs array<double>").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    priced = costed.mapInArrow(back, _schema(rows) + ", exits array<double>").repartition("conv_id", "piece")
    ways = priced.mapInArrow(inside, "conv_id long, piece long, ways array<struct<cost:long,letters:string,state:int>>")
    picked = ways.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(pick, "conv_id long, piece long, letters string, cost long")
    return join_null_safe(picked, pieces.select("conv_id", "piece", "first"), ["conv_id", "piece"])


def solved(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of each conversation, and its pieces with the letters of their edits (and the cost, in the first)."""
    counts, pieces = _pieces(turns)
    pieces = stage(pieces)
    columns = ["conv_id", "piece", "first", "letters", "cost"]
    found = _single(pieces).select(*columns)
    if pieces.where("pieces > 1").take(1):
        found = found.union(_several(pieces).select(*columns))
    return counts, stage(found)


def _applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired turns in order; a conversation lies in one partition, in order, and is read a turn at a time.

    A piece's letters come before the piece's first turn, so those at hand always cover the turn that is read.
    """
    texts = identified(rows, " ").select(*KEYS, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), "text", F.lit("").alias("letters"))
    marks = edits.select("conv_id", "first.*", F.lit(0).alias("kind"), "piece", F.lit("").alias("text"), "letters")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Repair()
        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != now.conv_id or not now.begun:
                    now.finish()
                    now.begin(row["conv_id"])
                now.read(row)
                if len(now.out) >= BATCH:
                    yield now.batch()
        now.finish()
        yield now.batch()

    both = texts.unionByName(marks).repartition("conv_id").sortWithinPartitions(*KEYS, "kind", "piece")
    return both.mapInArrow(apply, REPAIRED)


class _Repair:
    """Applies letters to the turns of one conversation after another."""

    def __init__(self):
        self.out: list[tuple] = []
        self.begun, self.conv_id = False, None
        self.letters: deque[str] = deque()

    def begin(self, conv_id: int | None) -> None:
        self.begun, self.conv_id, self.state, self.position = True, conv_id, 0, 0
        self.letters.clear()

    def _emit(self, letter: str, role: str, text: str) -> None:
        self.out.append((self.conv_id, self.position, letter, role, text))
        self.position += 1

    def _fill(self, letter: str, text: str) -> None:
        self.state = _NEXT[self.state]
        self._emit(letter, "user" if self.state == 2 else "assistant", text)

    def read(self, row: dict) -> None:
        if row["kind"] == 0:
            self.letters.extend(row["letters"])
            return
        while (letter := self.letters.popleft()) == "I":
            self._fill("I", "")
        if letter == "R":
            self._fill("R", row["text"])
        elif letter == "K":
            self.state = _KEEPS[self.state, row["role"][0]]
            self._emit("K", row["role"], row["text"])

    def finish(self) -> None:
        while self.letters:
            self.letters.popleft()
            self._fill("I", "")

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = zip(*self.out) if self.out else [[]] * 5
        made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["conv_id", "position", "edit", "role", "text"])
        self.out = []
        return made


def _digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` of the turns of :func:`_applied`, joined by line breaks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                if state is None or conv_id != ident:
                    if state is not None:
                        done.append((ident, state.hexdigest()))
                    ident, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield made(done)
            done = []
        if state is not None:
            yield made([(ident, state.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role, text."""
    return _applied(rows, solved(examine(rows))[1])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits' cost and letters, and the repaired text's digest."""
    counts, edits = solved(examine(rows))
    letters = F.array_sort(F.collect_list(F.struct("piece", "letters")))
    audit = edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("audit"))
    out = join_null_safe(counts.drop("pieces"), audit, ["conv_id"])
    out = join_null_safe(out, _digests(_applied(rows, edits)), ["conv_id"], "left")
    return out.select("conv_id", *NUMBERS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of the damaged conversations, one row for every original conv_id."""
    idents = conversations.select(F.col("conv_id").cast("long")).distinct()
    out = join_null_safe(idents, repair(damage(conversations)), ["conv_id"], "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NUMBERS]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
