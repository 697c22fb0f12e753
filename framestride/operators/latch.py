"""Latching objects to a grasping hand and propagating their poses.

Only the decision which object a grasp binds is sequential, and it happens once per grasp run. The
frames are therefore reduced to one event per grasp run, with everything the decision needs attached
by scans; the fold runs over these events, and the poses of all frames follow by joins and scans.

Inputs: ``hands`` with one row per (episode, pos, side): ``grasp`` and pose ``T`` (null when the hand is
not usable), both sides present at every position; ``objects`` with the static pose ``T`` per
(episode, obj).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import islands as I
from framestride.operators import series as S
from framestride.operators.bounds import bound, fits, with_bound
from framestride.operators.folds import bundled, stream_fold
from framestride.session import chunk_rows

REACH_M = 0.20
_RANK = {"left": 0, "right": 1}


def _rank(side: Column) -> Column:
    return F.when(side == "left", 0).otherwise(1)


def grasp_runs(hands: DataFrame) -> DataFrame:
    """Rows of grasp runs that follow a release, with the run and the position where it latches."""
    rows = I.segments(hands, "grasp", ["episode", "side"])
    rows = S.scan(
        rows,
        ["episode", "side"],
        "pos",
        [S.last_valid("_before", F.when(F.col("T").isNotNull(), F.col("pos")), inclusive=False)],
    )
    # A run that starts the recording has no release before it and never latches.
    rows = rows.where(F.col("grasp") & (F.col("seg.start") > 0)).withColumn("run", F.col("seg.start"))
    fresh = F.coalesce(F.col("_before") < F.col("run"), F.lit(True))
    return rows.withColumn("latches", F.col("T").isNotNull() & fresh).withColumn(
        "held", F.col("latches") | (~fresh)
    ).drop("seg", "_before")


class _Decider:
    """The bindings of a recording, one event after the other."""

    def __init__(self, disabled: frozenset[str]):
        self.disabled, self.poses, self.anchor, self.seen = disabled, {}, None, -1
        self.locks: dict[str, tuple[str, np.ndarray] | None] = {"left": None, "right": None}

    def step(self, row: dict) -> tuple | None:
        poses, locks = self.poses, self.locks
        if row["key"] < 0:
            poses[row["obj"]] = np.asarray(row["T"], float).reshape(4, 4)
            self.anchor = row["obj"] if row["is_anchor"] else self.anchor
            return None
        # Bring the poses up to this moment: the latest update of each side since the last event.
        updates = [(side, row[f"{side}_key"], row[f"{side}_T"]) for side in ("left", "right")]
        for side, _, pose in sorted((u for u in updates if u[2] is not None and u[1] > self.seen), key=lambda u: u[1]):
            if locks[side] is not None and side not in self.disabled:
                obj, lock = locks[side]
                poses[obj] = np.asarray(pose, float).reshape(4, 4) @ lock
        hand = np.asarray(row["T"], float).reshape(4, 4)
        near = [(np.linalg.norm(hand[:3, 3] - p[:3, 3]), o) for o, p in sorted(poses.items()) if o != self.anchor]
        best = min(near, key=lambda n: n[0], default=(np.inf, None))
        self.seen, side = row["key"], row["side"]
        if not best[0] < REACH_M:
            locks[side] = None
            return None
        locks[side] = (best[1], np.linalg.inv(hand) @ poses[best[1]])
        return row["episode"], side, row["run"], best[1], locks[side][1].ravel()


def _decisions(rows: Sequence[dict], disabled: frozenset[str]) -> list[tuple]:
    decider = _Decider(disabled)
    return [made for made in map(decider.step, rows) if made is not None]


def _decide(batches: Iterator[pd.DataFrame], disabled: frozenset[str]) -> Iterator[pd.DataFrame]:
    decider = _Decider(disabled)
    for pdf in batches:
        out = [made for made in map(decider.step, pdf.to_dict("records")) if made is not None]
        yield pd.DataFrame(out, columns=["episode", "side", "run", "obj", "lock"])


def bindings(hands: DataFrame, objects: DataFrame, anchors: DataFrame, disabled: Sequence[str] = ()) -> DataFrame:
    """Object and rigid offset bound by each grasp run; runs without an object in reach are absent.

    The nearest non-anchor object closer than 0.20 m is taken, at its current pose.
    """
    rows = grasp_runs(hands)
    key = F.col("pos") * 2 + _rank(F.col("side"))
    update = F.struct(key.alias("key"), "T")
    rows = rows.withColumn("key", key)
    written = lambda side: F.when((F.col("side") == side) & F.col("T").isNotNull(), update)
    b = bound(hands, ["episode"])
    rows = with_bound(rows, "episode", 2 * b) if b is not None else rows  # two sides per position
    rows = S.scan(
        rows, ["episode"], "key", [S.last_valid(f"_{s}", written(s), inclusive=False) for s in ("left", "right")]
    )
    events = rows.where("latches").select(
        "episode", "key", "side", "run", "T", F.col("_left.key").alias("left_key"), F.col("_left.T").alias("left_T"),
        F.col("_right.key").alias("right_key"), F.col("_right.T").alias("right_T"),
    )
    first = objects.join(anchors, "episode", "left").select(
        "episode", "obj", "T", F.coalesce(F.col("obj") == F.col("anchor_key"), F.lit(False)).alias("is_anchor"),
        F.lit(-1).cast("long").alias("key"),
    )
    stream = events.unionByName(first, allowMissingColumns=True).withColumns(
        {k: F.coalesce(F.col(k), F.lit(-1).cast("long")) for k in ("left_key", "right_key", "run")}
    )
    kind = hands.schema["episode"].dataType.simpleString()
    off = frozenset(disabled)

    schema = f"episode {kind}, side string, run long, obj string, lock array<double>"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _decide(batches, off)

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = table.to_pylist()
        out = [row for a, b in zip(starts, [*starts[1:], len(rows)]) for row in _decisions(rows[a:b], off)]
        types = (table.schema.field("episode").type, pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names=["episode", "side", "run", "obj", "lock"])

    if fits(hands, ["episode"], chunk_rows(hands)):
        return bundled(stream, ["episode"], ["key", "obj"], work, schema)
    return stream_fold(stream, ["episode"], ["key", "obj"], fold, schema)


def propagate(
    hands: DataFrame, objects: DataFrame, anchors: DataFrame, disabled: Sequence[str] = ()
) -> DataFrame:
    """Object poses of every frame: ``episode, pos, obj, T, is_dynamic``.

    A held object follows the hand, keeps its pose while the hand is missing, and stays where it is
    after the release. When both hands hold one object, the right hand wins.
    """
    bound_runs = bindings(hands, objects, anchors, disabled)
    rows = grasp_runs(hands).where("held").select("episode", "pos", "side", "run", "T")
    held = rows.join(bound_runs, ["episode", "side", "run"])
    if disabled:
        held = held.where(~F.col("side").isin(*disabled))
    held = held.withColumn("_w", F.when(F.col("T").isNotNull(), F.array(*G.compose("T", "lock"))))
    writes = held.groupBy("episode", "obj", "pos").agg(
        F.max_by("_w", F.when(F.col("_w").isNotNull(), _rank(F.col("side")))).alias("_w")
    )
    frames = hands.where(F.col("side") == "left").select("episode", "pos")
    grid = frames.join(objects.select("episode", "obj", F.col("T").alias("_static")), "episode")
    full = grid.join(writes.withColumn("_held", F.lit(True)), ["episode", "obj", "pos"], "left")
    full = S.scan(full, ["episode", "obj"], "pos", [S.last_valid("_now", "_w")])
    return full.select(
        "episode", "pos", "obj", F.coalesce("_now", "_static").alias("T"),
        F.coalesce("_held", F.lit(False)).alias("is_dynamic"),
    )


def online_latch(hands: DataFrame, objects: DataFrame, reach: float = REACH_M) -> DataFrame:
    """Online policy: static objects, anchor included, retried on every closed frame.

    Returns the frames on which an object follows a hand. A frame without the hand changes nothing
    and shows the static pose. The nearest static object does not depend on earlier frames, so no
    sequential pass is needed.
    """
    seen = hands.where(F.col("T").isNotNull())
    pairs = seen.select("episode", "side", "pos", "T").join(objects.select("episode", "obj", F.col("T").alias("_o")), "episode")
    gap = G.norm(G.sub(G.translation("T"), G.translation("_o")))
    near = pairs.groupBy("episode", "side", "pos").agg(
        F.min_by(F.struct("obj", "_o", gap.alias("gap")), F.struct(gap, "obj")).alias("near")
    )
    rows = seen.join(near, ["episode", "side", "pos"], "left")
    rows = S.densify(rows, ["episode", "side"], "pos", "_at")
    rows = I.segments(rows, "grasp", ["episode", "side"], "_at").where("grasp")
    lock = F.struct("_at", F.col("near.obj").alias("obj"), F.array(*G.inverse_affine("T")).alias("inv"), F.col("near._o").alias("o"))
    hit = F.when(F.col("near.gap") < reach, lock)
    rows = S.scan(rows.withColumn("_hit", hit), ["episode", "side"], "_at", [S.last_valid("_prev", "_hit", inclusive=False)])
    # The first hit of the run decides; it is the one without an earlier hit in the same run.
    first = F.when(
        F.col("_hit").isNotNull() & ~F.coalesce(F.col("_prev._at") >= F.col("seg.start"), F.lit(False)), F.col("_hit")
    )
    rows = S.scan(rows.withColumn("_first", first), ["episode", "side"], "_at", [S.last_valid("_lock", "_first")])
    rows = rows.where(F.col("_lock._at") >= F.col("seg.start"))
    rows = rows.withColumn("_offset", F.array(*G.compose("_lock.inv", "_lock.o")))
    return rows.select(
        "episode", "side", "pos", F.col("_lock.obj").alias("obj"), F.array(*G.compose("T", "_offset")).alias("T")
    )


#: Phases of a hand: closed since the recording began, open, closed without a decision, closed with one.
INITIAL, OPEN, UNDECIDED, DECIDED = range(4)


def next_phase(policy: str, phase: int, grasp: bool, visible: bool) -> int:
    """A hand's phase before a frame's decision: runs of grasp rows begin where an open phase ends."""
    if policy == "online" and not visible:
        return phase
    if not grasp:
        return OPEN
    return UNDECIDED if phase == OPEN else phase


def reference_step(state: dict, policy: str, poses: dict, hands: dict, anchor, reach: float = REACH_M) -> dict:
    """One frame of the latch rules for a small in-memory state; streaming uses it per arriving frame.

    ``state`` holds phase, object and offset per side, as the batch form holds one binding per grasp run. ``poses`` are
    the current object poses (``dataset``) or the static ones (``online``); ``hands`` maps a side to (grasp, pose or None).
    Returns the objects moved in this frame.
    """
    online, moved = policy == "online", {}
    for side in sorted(hands, key=_RANK.get):
        grasp, pose = hands[side]
        known = state.get(side, {"phase": OPEN if online else INITIAL, "obj": None, "offset": None})
        obj, offset = known["obj"], known["offset"]
        phase = next_phase(policy, known["phase"], grasp, pose is not None)
        if phase == OPEN:
            obj = offset = None
        if phase == UNDECIDED and pose is not None:
            gaps = {o: float(np.linalg.norm(pose[:3, 3] - p[:3, 3])) for o, p in poses.items() if online or o != anchor}
            obj = min(gaps, key=lambda o: (gaps[o], o), default=None)
            obj = obj if obj is not None and gaps[obj] < reach else None
            offset = None if obj is None else np.linalg.inv(pose) @ poses[obj]
            phase = UNDECIDED if online and obj is None else DECIDED
        state[side] = {"phase": phase, "obj": obj, "offset": offset}
        if obj is not None and pose is not None:
            moved[obj] = pose @ offset
            if not online:
                poses[obj] = moved[obj]
    return moved
