"""From the per-frame records of a recording to its training table.

The records of all kinds and the objects of a recording are moved once, to one partition per recording, and meet there
in one grouping; the latch runs over the sorted rows of the partition. It looks at single rows only where a hand's grasp
changes or a closed hand is first seen; between these, object poses are matrix products over whole stretches of rows.
A recording of more than ``framestride.chunkRows`` frames goes through the split form of the latch instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.operators import latch as L
from framestride.operators import series as S
from framestride.operators.dataset import KEY, finished_by_mode
from framestride.session import chunk_rows, stage
from framestride.sources.records import CORRUPT, flat, robot_arm

SIDES = ("left", "right")
OBJECTS = "array<struct<obj:string,T:array<double>,is_dynamic:boolean>>"


def presence(tables: dict[str, DataFrame], by: Sequence[str] = KEY) -> DataFrame:
    """One row per frame with the record of each table as a struct, null where the table has none.

    One grouping over all tables instead of a join for each; the rows are moved once, by ``by``. A frame that a table holds
    twice keeps one of its records. A table of nothing but keys counts as well.
    """
    parts = []
    for name, t in tables.items():
        record = F.struct(*[c for c in t.columns if c not in KEY] or [F.lit(True).alias("listed")])
        parts.append(t.select(*KEY, record.alias(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.repartition(*by).groupBy(*KEY).agg(*[F.first(name, ignorenulls=True).alias(name) for name in tables])


def complete(tables: Sequence[str]) -> Column:
    """Whether a frame of :func:`presence` has every record."""
    out = F.lit(True)
    for name in tables:
        out = out & F.col(name).isNotNull()
    return out


def counters(frames: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Total, valid, missing-record and no-hand frames per recording.

    ``frames`` is :func:`presence` of these tables and of one that lists all frames, as those without any record count too.
    """
    whole = complete(tables)
    seen = F.coalesce(F.size(F.col("hands.hands")) > 0, F.lit(False))
    return frames.groupBy("episode").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(whole).alias("valid"),
        F.count_if(~whole).alias("discarded_missing_file"),
        F.count_if(whole & ~seen).alias("discarded_no_hand"),
    )


def _statics(objects: DataFrame, anchors: DataFrame) -> DataFrame:
    """The objects of each recording as one array, and its anchor."""
    items = objects.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("obj", "T"))).alias("_objects"))
    return items.join(anchors.select("episode", "anchor_key"), "episode", "full_outer")


def training_table(
    tables: dict[str, DataFrame], objects: DataFrame, anchors: DataFrame, disabled: Sequence[str] = (), rows: int | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """The training records of all frames that have every record.

    ``tables`` holds ``cameras`` (ts, w, h, fps, k, c2w), ``hands`` (``hands``: a map from side to pose and grasp),
    ``phases`` (mode), ``slam``, and any further hand methods as ``hands_<method>``, which may be absent on a frame: null
    where the method was not run, empty where it saw nothing (J03). ``objects``: episode, obj, static T; ``anchors``:
    episode, anchor_key, the object that no hand moves. A side in ``disabled`` moves nothing. A hand whose pose is null is
    not in the table's ``hands``, but its grasp counts. A hand is closed above the grasp ``threshold``. Instead of ``phases`` and
    ``slam``, ``cameras`` may bring its own ``is_finished``.
    """
    longest = tables["cameras"].groupBy("episode").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= (rows or chunk_rows(tables["cameras"])):
        out = _folded(_assembled(tables, _statics(objects, anchors), ["episode"], threshold), disabled)
    else:
        frames = _assembled(tables, _statics(objects, anchors), KEY, threshold).where("_static is null").drop("_static")
        out = _split(stage(frames), objects, anchors, disabled)
    moved = F.map_from_entries(F.transform("_moved", lambda o: F.struct(o["obj"], F.struct(o["T"].alias("T"), o["is_dynamic"].alias("is_dynamic")))))
    return out.withColumn("objects", moved).drop("_moved")


def _assembled(tables: dict[str, DataFrame], statics: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Complete frames, and the objects of each recording as a frame -1."""
    needed = [t for t in tables if not t.startswith("hands_")]
    number = tables["cameras"].schema["frame_idx"].dataType
    first = statics.withColumn("frame_idx", F.lit(-1).cast(number))
    frames = presence({**tables, "_static": first}, by).where(complete(needed) | F.col("_static").isNotNull())
    seen = F.map_filter("hands.hands", lambda _, h: h["T"].isNotNull())
    finished = F.col("cameras.is_finished") if "is_finished" in tables["cameras"].columns else finished_by_mode(F.col("phases.mode"))
    methods = [F.col(f"{t}.hands").alias(t) for t in tables if t not in needed]
    return frames.select(
        *KEY, *[F.col(f"cameras.{c}").alias(c) for c in ("ts", "w", "h", "fps", "k", "c2w")],
        finished.alias("is_finished"), seen.alias("hands"), *methods,
        *[_side(s, threshold).alias(f"_{s}") for s in SIDES], "_static",
    )


def _side(side: str, threshold: float) -> Column:
    hand = F.try_element_at("hands.hands", F.lit(side))
    return F.struct(F.coalesce(hand["grasp"] > F.lit(threshold), F.lit(False)).alias("grasp"), hand["T"].alias("T"))


def _folded(frames: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """Latch over partitions that hold whole recordings."""
    rows = frames.sortWithinPartitions(*KEY)
    names = [c for c in rows.columns if c not in ("_static", "_left", "_right")]
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in names) + f", anchor_key string, _moved {OBJECTS}"
    off = frozenset(disabled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latch: _Latch | None = None
        for batch in batches:
            episodes = batch.column(batch.schema.get_field_index("episode")).to_pylist()
            index = batch.column(batch.schema.get_field_index("frame_idx")).to_numpy()
            cuts = [0, *[k for k in range(1, len(episodes)) if episodes[k] != episodes[k - 1]], len(episodes)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if latch is None or latch.episode != episodes[start]:
                    latch = _Latch(episodes[start], off)
                if index[start] < 0:
                    static = part.column(part.schema.get_field_index("_static"))[0].as_py()
                    latch.place(static["_objects"] or [], static["anchor_key"])
                    part = part.slice(1)
                if part.num_rows:
                    hands = [_hand(part.column(part.schema.get_field_index(f"_{s}"))) for s in SIDES]
                    kept = [part.column(part.schema.get_field_index(c)) for c in names]
                    anchor = pa.array([latch.anchor] * part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([*kept, anchor, latch.run(hands)], [*names, "anchor_key", "_moved"])

    return rows.mapInArrow(run, schema)


def _hand(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grasp, whether there is a pose, and poses (rows, 4, 4)."""
    grasp = column.field("grasp").fill_null(False).to_numpy(zero_copy_only=False)
    poses = column.field("T")
    there = poses.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(grasp), 4, 4))
    out[there] = np.array([p for p in poses.drop_null().to_pylist()], float).reshape(-1, 4, 4)
    return grasp, there, out


class _Latch:
    """The state of the latch in one recording, advanced over stretches of its frames."""

    def __init__(self, episode, disabled: frozenset[str]):
        self.episode, self.disabled, self.anchor = episode, disabled, None
        self.poses: dict[str, np.ndarray] = {}
        self.machine: dict = {}

    def place(self, objects: list[dict], anchor: str | None) -> None:
        self.poses = {o["obj"]: np.asarray(o["T"], float).reshape(4, 4) for o in objects}
        self.anchor = anchor

    def _events(self, hands) -> list[int]:
        """Rows at which a decision may fall: a grasp changes, or a closed hand is seen for the first time since."""
        n = len(hands[0][0])
        at = np.zeros(n, bool)
        at[0] = True
        for grasp, there, _ in hands:
            change = np.flatnonzero(grasp[1:] != grasp[:-1]) + 1
            at[change] = True
            seen = grasp & there
            starts = np.concatenate([[0], change])
            before = np.concatenate([[0], np.cumsum(seen)])
            run = np.searchsorted(starts, np.arange(n), "right") - 1
            at |= seen & (before[:-1] == before[starts[run]])
        return np.flatnonzero(at).tolist()

    def _step(self, hands, k: int) -> None:
        now = {s: (bool(h[0][k]), h[2][k] if h[1][k] else None) for s, h in zip(SIDES, hands)}
        poses = self.poses
        held = {s: poses.copy() for s in self.disabled}
        # A disabled side decides like the other, but moves nothing.
        for side in SIDES:
            own = held.get(side, poses)
            L.reference_step(self.machine, "dataset", own, {side: now[side]}, self.anchor)

    def run(self, hands) -> pa.Array:
        """Poses and dynamic flags of all objects for the rows of ``hands``."""
        n, names = len(hands[0][0]), list(self.poses)
        out = np.zeros((n, len(names), 4, 4))
        dynamic = np.zeros((n, len(names)), bool)
        events = [*self._events(hands), n]
        for start, stop in zip(events, events[1:]):
            self._step(hands, start)
            for k, name in enumerate(names):
                out[start, k] = self.poses[name]
                where, poses = np.zeros(stop - start, np.int64), [self.poses[name][None]]
                for side, (_, there, pose) in zip(SIDES, hands):
                    bound = self.machine.get(side, {"obj": None})
                    if bound["obj"] != name or side in self.disabled:
                        continue
                    dynamic[start:stop, k] = True
                    rows = np.flatnonzero(there[start + 1 : stop]) + 1
                    where[rows] = np.arange(len(rows)) + sum(map(len, poses))
                    poses.append(pose[start + rows] @ bound["offset"])
                if len(poses) > 1:
                    # A row without the hand keeps the pose of the row before.
                    last = np.maximum.accumulate(np.where(where > 0, np.arange(stop - start), 0))
                    out[start:stop, k] = np.concatenate(poses)[where[last]]
                    self.poses[name] = out[stop - 1, k]
                else:
                    out[start:stop, k] = self.poses[name]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n * len(names) + 1, dtype=np.int32) * 16), pa.array(out.ravel()))
        items = pa.StructArray.from_arrays([pa.array(names * n, pa.string()), flat, pa.array(dynamic.ravel())], ["obj", "T", "is_dynamic"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(names)), items)


def _split(frames: DataFrame, objects: DataFrame, anchors: DataFrame, disabled: Sequence[str]) -> DataFrame:
    """The same by the split latch: decisions once per grasp, poses by scans over chunks."""
    frames = S.densify(frames, ["episode"], "frame_idx", "pos")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"_{s}.grasp").alias("grasp"), F.col(f"_{s}.T").alias("T")) for s in SIDES])).alias("hand")
    hands = frames.select("episode", "pos", sides).select("episode", "pos", "hand.*")
    moved = L.propagate(hands, objects, anchors, disabled)
    moved = moved.groupBy("episode", "pos").agg(F.array_sort(F.collect_list(F.struct("obj", "T", "is_dynamic"))).alias("_moved"))
    out = frames.join(moved, ["episode", "pos"], "left").join(anchors.select("episode", "anchor_key"), "episode", "left")
    kept = [c for c in frames.columns if c not in ("_left", "_right", "pos")]
    return out.select(*kept, "anchor_key", F.coalesce("_moved", F.expr(f"cast(array() as {OBJECTS})")).alias("_moved"))


# --- robot sessions ------------------------------------------------------------------------------------


def robot_table(
    states: DataFrame, images: DataFrame, meta: DataFrame, objects: DataFrame, anchors: DataFrame, threshold: float = 0.5,
    tail: int = 30, disabled: Sequence[str] = (),
) -> DataFrame:
    """The training records of robot sessions.

    ``states``: records of kind ``robot``; ``images``: episode and frame_idx of every image; ``meta``:
    :func:`framestride.sources.records.session_meta`. A frame needs its state and its image, and a session its metadata: others
    are left out, like unreadable states. The left arm takes part only in sessions with ``dual_arm``; an arm that does not is
    open and absent. A gripper closed by more than half counts as a grasp of 1, any other or none as 0. ``joints`` of an
    arm stay with its hand. The camera stands at the origin. The last ``tail`` images of a session are finished, whatever
    their state says. Repeated frames count once.
    """
    images = images.select(*KEY).dropDuplicates(KEY)
    placed = S.scan(images, ["episode"], "frame_idx", [S.position("_t"), S.total("_n", F.count(F.lit(1)))])
    if CORRUPT in states.columns:
        states = states.where(F.col(CORRUPT).isNull())
    facts = meta.select("episode", "w", "h", "fps", flat(F.col("k")).alias("k"), "dual_arm")
    frames = states.join(placed, list(KEY)).join(facts, "episode")
    last = (F.col("_t") >= F.col("_n") - tail) & F.lit(tail > 0)
    finished = F.when(last, 1.0).otherwise(F.coalesce(F.col("is_finished").cast("double"), F.lit(0.0)))
    origin = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    cameras = frames.select(*KEY, "ts", "w", "h", "fps", "k", origin.alias("c2w"), finished.alias("is_finished"))
    hands = []
    for side in SIDES:
        arm = robot_arm(side)
        joints = F.coalesce(arm["joints"], F.col("joints")) if side == "right" else arm["joints"]
        closed = F.when(1 - arm["gripper_q"] > 0.5, 1.0).otherwise(0.0)
        hand = F.struct(flat(arm["T_ee_in_cam"]).alias("T"), closed.alias("grasp"), joints.alias("joints"))
        active = F.lit(True) if side == "right" else F.col("dual_arm")
        hands.append(F.when(active & arm.isNotNull(), F.struct(F.lit(side).alias("side"), hand.alias("hand"))))
    entries = F.map_from_entries(F.array_compact(F.array(*hands)))
    tables = {"cameras": cameras, "hands": frames.select(*KEY, entries.alias("hands"))}
    return training_table(tables, objects, anchors, disabled, threshold=threshold)
