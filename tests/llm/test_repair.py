import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from framestride.llm import queries, repair

ROWS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
SPACE = "\x20\t\n\x0b\x0c\r"


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def step(state, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))


def plain(turns):
    """Cheapest cost and ASCII-least letters by a table of (cost, letters) over (turns read, state)."""
    kinds = faults(turns)
    ways = {0: (0, "", ())}

    def offer(to, state, way):
        if state is not None and (state not in to or way < to[state]):
            to[state] = way

    def inserted(ways):
        for _ in range(4):
            for state, (cost, letters, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    offer(ways, step(state, role[0]), (cost + 5, letters + "I", (*out, f"{role}:")))

    inserted(ways)
    for (role, text), kind in zip(turns, kinds):
        after = {}
        for state, (cost, letters, out) in ways.items():
            offer(after, state, (cost + 2, letters + "D", out))
            if kind not in ("blank", "duplicate"):
                more = 5 if kind == "truncated" else 0
                offer(after, step(state, role[:1]), (cost + more, letters + "K", (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    offer(after, step(state, new[0]), (cost + more + 1, letters + "R", (*out, f"{new}:{text}")))
        inserted(after)
        ways = after
    return min((ways[s] for s in (0, 3) if s in ways), default=(0, "", ()))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def expected(rows):
    turns = [(r, t) for _, r, t in rows]
    cost, letters, out = plain(turns)
    numbers = {n for n, _, _ in rows if n is not None}
    kinds = faults(turns)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def made(seed, n, longest):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \n", "", "Fine. \t", "x.\x0b", "\xa0", "日本.", "a\n."]
    rows = []
    for conv in range(n):
        for turn in range(pick.randrange(1, longest)):
            if pick.random() < 0.05:
                continue
            role = ("user", "assistant")[turn % 2] if pick.random() < 0.7 else pick.choice(["system", "user", "assistant", "tool", "", None, "User", "umpire"])
            text = pick.choice(texts) + (str(turn) + "." if pick.random() < 0.7 else "")
            rows.append((conv, turn, role, None if pick.random() < 0.05 else text))
    return rows


@pytest.mark.parametrize("piece", [1, 2, 5, 64])
def test_auction_equals_a_plain_table(piece):
    pick = random.Random(piece)
    for _ in range(400):
        turns = [(pick.choice(["user", "assistant", "system", "x"]), pick.choice(["a.", "b.", "c", "", f"{pick.random()}."])) for _ in range(pick.randrange(0, 14))]
        kinds = [{"blank": 2, "duplicate": 2, "truncated": 1, None: 0}[k] for k in faults(turns)]
        codes = bytes(3 * min("uasx".index(r[0]), 3) + k for (r, _), k in zip(turns, kinds))
        parts = [codes[k : k + piece] for k in range(0, len(codes), piece)] or [b""]
        exits = [repair.ENDS]
        exits.append(tuple(w[0] for w in repair.solve(parts[-1], repair.ENDS, True, (0, 1, 2, 3))))
        for part in parts[-2::-1]:
            table = repair.costs(part)
            exits.append(tuple(min(table[4 * s + t] + exits[-1][t] for t in range(4)) for s in range(4)))
        state, letters = 0, ""
        for k, part in enumerate(parts):
            cost, got, state = repair.solve(part, exits[len(parts) - 1 - k], k == len(parts) - 1, (0, 1, 2, 3))[state]
            letters += got
            assert k or cost == plain(turns)[0]
        assert letters == plain(turns)[1]


def test_prices_are_costs_and_never_exceed_an_arc():
    lattice = repair.Lattice([0, 3, 8, 10, 1, 4, 0, 0, 3], repair.ENDS, True)
    lattice.auction(0)
    for node, arcs in enumerate(lattice.arcs):
        assert all(lattice.price[node] <= cost + lattice.price[to] for _, cost, to in arcs)


@pytest.mark.parametrize("piece", [64, 3])
def test_repair_of_damaged_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = made(5, 120, 30) + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ok."), (500, None, None, None), (501, None, "user", "A."), (501, 7, "assistant", "B.")]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    for c in ("k", "piece", "cost", "fault", "copy", "first", "letters", "state", "_row"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_damaged(df).collect()}
    want = {c: expected(v) for c, v in damaged(rows).items()}
    assert {c: (got.get(c), w) for c, w in want.items() if got.get(c) != w} == {} and len(got) == len(want)


def test_repaired_turns_follow_the_pattern(spark):
    rows = made(8, 40, 12)
    out = {}
    for r in repair.repaired_turns(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "position").collect():
        out.setdefault(r["conv_id"], []).append(r)
    assert len(out) > 30
    for turns in out.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns)) and [r["position"] for r in turns] == list(range(len(turns)))
        assert all(r["text"] == "" for r in turns if r["edit"] == "I")


def test_repeated_rows_of_one_conversation(spark):
    rows = [(1, 3, "user", "Same.")] * 300 + [(1, 4, "assistant", "Done.")]
    got = repair.repair(spark.createDataFrame(rows, ROWS)).collect()
    assert [tuple(r)[1:] for r in got] == [expected([(3, "user", "Same.")] * 300 + [(4, "assistant", "Done.")])]


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert repair.repair_damaged(spark.createDataFrame([], ROWS)).count() == 0


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == {c: expected(v) for c, v in damaged(rows).items()}
