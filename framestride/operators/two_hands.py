"""Targets and evaluation of both hands and an object over a horizon.

Targets are built per chunk of a recording with the frames of one horizon behind it, many chunks at a time: each step of
the horizon is one array operation over all samples of the chunks, so no frame is copied per step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.functions.geometry import lit
from framestride.operators import series as S
from framestride.operators.features import _pose9_batch
from framestride.operators.folds import bundled
from framestride.session import chunk_rows

SIDES = ("left", "right")
#: Frames of a chunk: the targets of a chunk are held at once.
ROWS = 4096
IMAGE_CENTRE, NEAR = 0.5, 1e-4


def _poses(column: pa.Array, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Square matrices of a list column (identity where there is none) and whether there is one."""
    rows = column.to_pylist()
    known = np.array([r is not None and len(r) == size * size and None not in r for r in rows], bool)
    out = np.tile(np.eye(size), (len(rows), 1, 1))
    if known.any():
        out[known] = np.array([r for r, ok in zip(rows, known) if ok], float).reshape(-1, size, size)
    return out, known


def _inverted(poses: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses; a pose that has none counts as absent."""
    known = known & np.isfinite(poses).all((1, 2))
    known[known] &= np.abs(np.linalg.det(poses[known])) > 1e-12
    out = np.tile(np.eye(poses.shape[1]), (len(poses), 1, 1))
    out[known] = np.linalg.inv(poses[known])
    return out, known


def _pixels(points: np.ndarray, w2c: np.ndarray, k: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pixels as shares of the image, its centre for points that are not in front of the camera."""
    seen = np.einsum("nij,nj->ni", w2c[:, :3, :3], points) + w2c[:, :3, 3]
    front = seen[:, 2] >= NEAR
    z = np.where(front, seen[:, 2], 1.0)
    uv = np.stack([k[:, i, i] * seen[:, i] / z + k[:, i, 2] for i in (0, 1)], 1) / size
    return np.where(front[:, None], np.clip(uv, 0.0, 1.0), IMAGE_CENTRE)


class _Steps:
    """A value per sample that goes on from step to step; zero at first."""

    def __init__(self, shape: tuple[int, ...]):
        self.now, self.all = np.zeros(shape), []

    def put(self, rows: np.ndarray, values: np.ndarray) -> None:
        self.now[rows] = values

    def step(self) -> None:
        self.all.append(self.now.copy())


class _Origin:
    """The first pose of each sample, that ``delta`` actions are relative to."""

    def __init__(self, n: int, delta: bool):
        self.delta, self.known, self.inverse = delta, np.zeros(n, bool), np.tile(np.eye(4), (n, 1, 1))

    def relative(self, rows: np.ndarray, poses: np.ndarray) -> np.ndarray:
        if not self.delta:
            return poses
        fresh = ~self.known[rows]
        self.inverse[rows[fresh]] = _inverted(poses[fresh], np.ones(fresh.sum(), bool))[0]
        self.known[rows] = True
        return self.inverse[rows] @ poses


def two_hand_targets(
    frames: DataFrame, horizon: int, mean: Sequence[float], std: Sequence[float], frame_mode: str = "camera_frame",
    action: str = "absolute", sides: Sequence[str] = SIDES, dominant: str = "right", stride: int = 1, latch: bool = True,
    sample: Column | None = None,
) -> DataFrame:
    """Targets of every frame (or of those where ``sample`` holds): one row with an array per kind, one entry per step.

    ``actions``: for each step the positions of all hands, then their rotations, then their grasps (10 numbers a hand);
    ``object``: 9 numbers of the sample's anchor object; ``trace``: the pixel of each hand and of the object; ``done``.
    A step without a frame repeats the step before, as does a hand that its frame lacks; a frame without the object gives
    zeros for it. While the ``dominant`` hand grasps, the object follows it with the offset of the first such step, and is
    taken as tracked again after the release, whichever hand moves it. ``delta`` actions are relative to the first step
    that has the entity. A sample without reference or camera pose has zeros.
    """
    if action not in ("absolute", "delta"):
        raise ValueError(f"unknown action mode: {action}")
    if frame_mode not in ("camera_frame", "anchor_frame"):
        raise ValueError(f"unknown frame mode: {frame_mode}")
    if latch and dominant not in sides:
        raise ValueError(f"the dominant hand is not among the sides: {dominant}")
    reference = F.col("cam0" if frame_mode == "camera_frame" else "anchor")
    hands = [F.try_element_at("hands", F.lit(s)) for s in sides]
    rows = frames.select(
        "episode", F.col("frame_idx").cast("long").alias("frame_idx"), (F.lit(True) if sample is None else sample).alias("_sample"),
        reference.alias("_ref"), "c2w", F.col("k").alias("_k"), "w", "h_px", "anchor_key", "is_finished",
        F.map_from_entries(F.transform(F.map_entries("objects"), lambda e: F.struct(e["key"], e["value"]["T"]))).alias("_objects"),
        *[F.struct(h["T"].alias("T"), h["grasp"].cast("double").alias("grasp")).alias(f"_{s}") for h, s in zip(hands, sides)],
    )
    halo, _ = S.with_halo(rows, ["episode"], "frame_idx", 0, horizon * stride, min(chunk_rows(frames), ROWS))
    kind = frames.schema["episode"].dataType.simpleString()
    number = frames.schema["frame_idx"].dataType.simpleString()
    many, mean_, std_ = len(sides), np.asarray(mean, float), np.asarray(std, float)

    def build(table: pa.Table, starts: np.ndarray) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        # Frames of different chunks lie further apart than a horizon reaches.
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        index = column("frame_idx").to_numpy()
        index = index - index.min() + group * (index.max() - index.min() + horizon * stride + 1)
        own = np.flatnonzero(column("_own").to_numpy(zero_copy_only=False) & column("_sample").fill_null(False).to_numpy(zero_copy_only=False))
        refs, has_ref = _inverted(*_poses(column("_ref").take(pa.array(own))))
        w2c, has_camera = _inverted(*_poses(column("c2w").take(pa.array(own))))
        k3, has_k = _poses(column("_k").take(pa.array(own)), 3)
        size = np.stack([column(c).to_numpy(zero_copy_only=False)[own].astype(float) for c in ("w", "h_px")], 1)
        usable, seen = has_ref, has_camera & has_k & np.isfinite(size).all(1)
        hands = {s: (*_poses(column(f"_{s}").field("T")), column(f"_{s}").field("grasp").fill_null(0.0).to_numpy(zero_copy_only=False) > 0.5) for s in sides}
        anchors = np.array([a or "" for a in column("anchor_key").take(pa.array(own)).to_pylist()], object)
        maps = [dict(m) if m is not None else {} for m in column("_objects").to_pylist()]
        objects = {}
        for a in set(anchors.tolist()):
            of = np.flatnonzero(np.isin(group, group[own[anchors == a]]))
            place = np.zeros(len(maps), np.int64)
            place[of] = np.arange(len(of))
            objects[a] = (*_poses(pa.array([maps[k].get(a) for k in of], pa.list_(pa.float64()))), place)
        finished = column("is_finished").cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)

        n = len(own)
        pos, rot, grasp = _Steps((n, many, 3)), _Steps((n, many, 6)), _Steps((n, many))
        obj, trace, done = _Steps((n, 9)), _Steps((n, many + 1, 2)), _Steps((n, 1))
        origins = {s: _Origin(n, action == "delta") for s in (*sides, "object")}
        locked, lock = np.zeros(n, bool), np.tile(np.eye(4), (n, 1, 1))
        for step in range(1, horizon + 1):
            want = index[own] + step * stride
            at = np.minimum(np.searchsorted(index, want), len(index) - 1)
            here = index[at] == want
            done.put(here, finished[at[here], None])
            for h, s in enumerate(sides):
                poses, known, closed = hands[s]
                rows_ = np.flatnonzero(here & known[at] & usable)
                world = poses[at[rows_]]
                nine = _pose9_batch(origins[s].relative(rows_, refs[rows_] @ world), mean_, std_)
                pos.now[rows_, h], rot.now[rows_, h], grasp.now[rows_, h] = nine[:, :3], nine[:, 3:], closed[at[rows_]]
                shown = rows_[seen[rows_]]
                trace.now[shown, h] = _pixels(poses[at[shown]][:, :3, 3], w2c[shown], k3[shown], size[shown])
            obj.put(here, 0.0)
            trace.now[here, many] = 0.0
            for a, (poses, known, place) in objects.items():
                rows_ = np.flatnonzero(here & (anchors == a) & usable)
                rows_ = rows_[known[place[at[rows_]]]]
                world = poses[place[at[rows_]]]
                if latch:
                    hand, there, closed = hands[dominant]
                    held = there[at[rows_]] & closed[at[rows_]]
                    first = held & ~locked[rows_]
                    lock[rows_[first]] = _inverted(hand[at[rows_[first]]], np.ones(first.sum(), bool))[0] @ world[first]
                    locked[rows_] = held
                    world[held] = hand[at[rows_[held]]] @ lock[rows_[held]]
                obj.put(rows_, _pose9_batch(origins["object"].relative(rows_, refs[rows_] @ world), mean_, std_))
                shown = seen[rows_]
                trace.now[rows_[shown], many] = _pixels(world[shown][:, :3, 3], w2c[rows_[shown]], k3[rows_[shown]], size[rows_[shown]])
            for value in (pos, rot, grasp, obj, trace, done):
                value.step()

        def stacked(*values: _Steps) -> np.ndarray:
            return np.concatenate([np.stack(v.all, 1).reshape(n, horizon, -1) for v in values], 2)

        made = {"actions": stacked(pos, rot, grasp), "object": stacked(obj), "trace": stacked(trace)}
        kept = table.select(["episode", "frame_idx"]).take(pa.array(own))
        columns = [kept.column(0), kept.column(1).cast(frame_type), *[_nested(v) for v in made.values()], _nested(stacked(done))]
        return pa.table(columns, names=["episode", "frame_idx", *made, "done"])

    frame_type = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[number]
    steps = ", ".join(f"{c} array<array<double>>" for c in ("actions", "object", "trace", "done"))
    return bundled(halo, ["episode", S.CHUNK], ["frame_idx"], build, f"episode {kind}, frame_idx {number}, {steps}")


def _nested(values: np.ndarray) -> pa.Array:
    """``array<array<double>>`` of (rows, steps, numbers)."""
    n, steps, width = values.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n * steps + 1, dtype=np.int32) * width), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * steps), inner)


# --- evaluation ------------------------------------------------------------------------------------


def side_errors(predictions: DataFrame, std: Sequence[float] = (1.0, 1.0, 1.0), sides: Sequence[str] = SIDES) -> DataFrame:
    """``errors``: per hand the physical position error, the rotation error and the grasp outcome, null for an absent hand.

    ``predictions`` has one row per sample and step with a struct per side (pos_pred, pos_true, o6d_pred, o6d_true, g_prob,
    g_true), null where the hand is absent.
    """

    scale = np.asarray(std, float)

    @F.pandas_udf("pos double, rot double, pred boolean, true boolean")
    def errors(hand: pd.DataFrame) -> pd.DataFrame:
        there = hand["pos_pred"].notna().to_numpy()
        known = hand[there]
        stacked = lambda c: np.array(known[c].tolist(), float).reshape(len(known), -1)
        out = pd.DataFrame({"pos": np.nan, "rot": np.nan, "pred": hand["g_prob"] >= 0.5, "true": hand["g_true"] >= 0.5}, index=hand.index)
        if len(known):
            out.loc[there, "pos"] = np.linalg.norm((stacked("pos_pred") - stacked("pos_true")) * scale, axis=1)
            out.loc[there, "rot"] = _turns(stacked("o6d_pred"), stacked("o6d_true"))
        return out

    made = [F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("side"), errors(s).alias("e"))) for s in sides]
    items = F.transform(F.array_compact(F.array(*made)), lambda x: F.struct(x["side"].alias("side"), x["e"]["pos"].alias("pos"), x["e"]["rot"].alias("rot"), x["e"]["pred"].alias("pred"), x["e"]["true"].alias("true")))
    return predictions.withColumn("errors", items)


def _turns(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Degrees between rotations of six numbers (the first two columns, row by row)."""

    def axes(v: np.ndarray) -> np.ndarray:
        unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        x, b = unit(v[:, 0::2]), v[:, 1::2]
        y = unit(b - (x * b).sum(1, keepdims=True) * x)
        return np.stack([x, y, np.cross(x, y)], 1)

    cosine = ((axes(one) * axes(two)).sum((1, 2)) - 1) / 2
    return np.degrees(np.arccos(np.clip(cosine, -0.999999, 0.999999)))


def two_hands_by_step(errors: DataFrame) -> DataFrame:
    """Errors per step over both hands as the mean over batches of batch means, and grasp counts.

    A sample's position error is the length of its hands' joint difference, its rotation error the mean of its hands'; an
    absent hand takes no part, nor does a sample without hands. One row per sample and step goes in, so one shuffle does.
    """
    total = lambda f: F.aggregate("errors", lit(0), lambda acc, e: acc + f(e))
    count = lambda f: F.sum(F.size(F.filter("errors", f)))
    shown = F.size("errors") > 0
    done = (F.col("done_prob") > 0.5) == (F.col("done_true") > 0.5)
    per_batch = errors.groupBy("batch_id", "k").agg(
        F.avg(F.when(shown, F.sqrt(total(lambda e: e["pos"] * e["pos"])))).alias("pos"),
        F.avg(F.when(shown, total(lambda e: e["rot"]) / F.size("errors"))).alias("rot"),
        count(lambda e: e["pred"] & e["true"]).alias("tp"),
        count(lambda e: e["pred"] & ~e["true"]).alias("fp"),
        count(lambda e: ~e["pred"] & e["true"]).alias("fn"),
        F.count_if(done).alias("done"),
        F.count(F.lit(1)).alias("n"),
    )
    return _over_batches(per_batch, ["k"])


def hands_by_step(errors: DataFrame) -> DataFrame:
    """The same for each hand on its own, over the samples that have it."""
    rows = errors.select("batch_id", "k", F.explode("errors").alias("e"))
    per_batch = rows.groupBy("batch_id", "k", "e.side").agg(
        F.avg("e.pos").alias("pos"),
        F.avg("e.rot").alias("rot"),
        F.count_if(F.col("e.pred") & F.col("e.true")).alias("tp"),
        F.count_if(F.col("e.pred") & ~F.col("e.true")).alias("fp"),
        F.count_if(~F.col("e.pred") & F.col("e.true")).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    return _over_batches(per_batch, ["k", "side"])


def _over_batches(per_batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = [c for c in ("tp", "fp", "fn", "done", "n") if c in per_batch.columns]
    out = per_batch.groupBy(*keys).agg(F.avg("pos").alias("pos_err"), F.avg("rot").alias("rot_err"), *[F.sum(c).alias(c) for c in counts])
    precision = F.col("tp") / F.greatest(lit(1), F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.greatest(lit(1), F.col("tp") + F.col("fn"))
    return out.withColumn("f1", 2 * precision * recall / F.greatest(lit(1e-8), precision + recall))
