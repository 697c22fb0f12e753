"""Training features: interaction tokens and action horizons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestride.functions import geometry as G
from framestride.functions.geometry import lit

# Token types and size.
PAD, HAND_LEFT, HAND_RIGHT, ANCHOR, OTHER = 0.0, 1.0, 2.0, 3.0, 4.0
MAX_TOKENS = 8
IDENTITY = (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


_POSE = T.ArrayType(T.DoubleType())


def _rows(series: pd.Series, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The non-null rows of an array column as a matrix, and where they are."""
    known = np.array([v is not None for v in series], dtype=bool)
    flat = np.concatenate(series[known].to_numpy()) if known.any() else np.empty(0)
    return flat.reshape(-1, width), known


def _emit(values: np.ndarray, known: np.ndarray) -> pd.Series:
    out = np.empty(len(known), dtype=object)
    for i, v in zip(np.flatnonzero(known), values):
        out[i] = v
    return pd.Series(out)


def _inverse_batch(m: np.ndarray) -> np.ndarray:
    return np.linalg.inv(m)


def _pose9_batch(m: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Normalised position and the orthonormalised first two columns, row by row."""
    pos = (m[:, :3, 3] - mean) / (std + 1e-8)
    a, b = m[:, :3, 0], m[:, :3, 1]
    x = a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-8)
    b = b - (x * b).sum(axis=1, keepdims=True) * x
    y = b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-8)
    return np.concatenate([pos, np.stack([x, y], axis=2).reshape(-1, 6)], axis=1)


def _pandas(fn, kind=_POSE):
    return F.pandas_udf(fn, kind)


def pose9(pose: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Normalised position and orthonormalised six-number rotation of a pose; null stays null."""
    mean_, std_ = np.asarray(mean, float), np.asarray(std, float)

    def encode(pose: pd.Series) -> pd.Series:
        m, known = _rows(pose)
        return _emit(_pose9_batch(m.reshape(-1, 4, 4), mean_, std_), known)

    return _pandas(encode)(pose)


def relative(inverse: Column, pose: Column) -> Column:
    """Product of an already inverted pose with a pose; null when one is null."""

    def product(inverse: pd.Series, pose: pd.Series) -> pd.Series:
        both = inverse.notna() & pose.notna()
        a, b = _rows(inverse.where(both, None))[0], _rows(pose.where(both, None))[0]
        return _emit((a.reshape(-1, 4, 4) @ b.reshape(-1, 4, 4)).reshape(-1, 16), both.to_numpy())

    return _pandas(product)(inverse, pose)


def inverse(pose: Column) -> Column:
    """Inverse pose; null stays null."""

    def invert(pose: pd.Series) -> pd.Series:
        m, known = _rows(pose)
        return _emit(_inverse_batch(m.reshape(-1, 4, 4)).reshape(-1, 16), known)

    return _pandas(invert)(pose)


def reference_inverse(frame_mode: str, cam0: str = "cam0", anchor: str = "anchor") -> Column:
    """World to reference frame: camera 0 or the static anchor."""
    if frame_mode not in ("camera_frame", "anchor_frame"):
        raise ValueError(f"unknown frame mode: {frame_mode}")
    return inverse(F.col(cam0 if frame_mode == "camera_frame" else anchor))


def tokens(
    reference: Column, hands: Column, objects: Column, anchor_key: Column, mean: Sequence[float], std: Sequence[float],
    sides: Sequence[str] = ("right",), use_objects: bool = True, size: int = MAX_TOKENS,
) -> Column:
    """Padded interaction tokens ``array<array<double>>`` and their mask.

    Order: the hands, the anchor object, the other objects by name. A token is the type, the pose in
    the reference frame (9), the hand(s) in the entity's frame (9 each) and a flag. A missing hand is
    a zero row that is masked out. Objects without a pose of 16 numbers have no token. ``dropped`` counts the entities
    for which ``size`` leaves no place. Rows with a null reference pose have only padding.
    """
    width = 1 + 9 + 9 * len(sides) + 1
    mean_, std_ = np.asarray(mean, float), np.asarray(std, float)
    kinds = [HAND_LEFT if side == "left" else HAND_RIGHT for side in sides]

    def build(reference: pd.Series, entities: pd.Series, counts: pd.Series, anchored: pd.Series, *hands_: pd.Series) -> pd.Series:
        n = len(reference)
        out = np.zeros((n, size, width))
        placed, seen = _rows(reference)
        inv = np.tile(np.eye(4), (n, 1, 1))
        inv[seen] = placed.reshape(-1, 4, 4)
        hand = []
        for i in range(len(sides)):
            m, known = _rows(hands_[2 * i])
            pose = np.tile(np.eye(4), (n, 1, 1))
            pose[known] = m.reshape(-1, 4, 4)
            hand.append((pose, known))

        def fill(rows: np.ndarray, slots: np.ndarray, poses: np.ndarray, kind, flag, related: bool) -> None:
            keep = slots < size
            rows, slots, poses = rows[keep], slots[keep], poses[keep]
            out[rows, slots, 0] = kind[keep]
            out[rows, slots, 1:10] = _pose9_batch(inv[rows] @ poses, mean_, std_)
            if related:
                back = _inverse_batch(poses)
                for i, (pose, known) in enumerate(hand):
                    part = _pose9_batch(back @ pose[rows], mean_, std_)
                    out[rows, slots, 10 + 9 * i : 19 + 9 * i] = np.where(known[rows, None], part, 0.0)
            out[rows, slots, -1] = flag[keep]

        for i, (pose, known) in enumerate(hand):
            rows = np.flatnonzero(known & seen)
            grasp = (hands_[2 * i + 1].to_numpy(float)[rows] > 0.5).astype(float)
            fill(rows, np.full(len(rows), i), pose[rows], np.full(len(rows), kinds[i]), grasp, use_objects)
        if use_objects:
            per_row = counts.to_numpy(int)
            rows = np.repeat(np.arange(n), per_row)
            if len(rows):
                poses = np.concatenate(entities[per_row > 0].to_numpy()).reshape(-1, 4, 4)
                rank = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
                kind = np.where((rank == 0) & anchored.to_numpy(bool)[rows], ANCHOR, OTHER)
                here = seen[rows]
                fill(rows[here], rank[here] + len(sides), poses[here], kind[here], np.full(int(here.sum()), -1.0), True)
        return pd.Series(list(out.reshape(n, -1)))

    # Objects with the anchor first, then by name; their poses as one flat array.
    entries = F.array_sort(
        F.transform(
            F.filter(F.map_entries(objects), lambda e: F.coalesce(F.size(e["value"]["T"]) == 16, F.lit(False))),
            lambda e: F.struct((e["key"] != anchor_key).alias("o"), e["key"].alias("k"), e["value"]["T"].alias("T")),
        )
    )
    poses = F.coalesce(F.flatten(F.transform(entries, lambda e: e["T"])), F.expr("cast(array() as array<double>)"))
    anchored = F.coalesce(F.size(F.try_element_at(objects, anchor_key)["T"]) == 16, F.lit(False))
    args = [reference, poses, (F.size(poses) / 16).cast("int"), anchored]
    for side in sides:
        h = F.try_element_at(hands, F.lit(side))
        args += [h["T"], F.coalesce(h["grasp"], lit(0))]
    flat = _pandas(build)(*args)
    return G.let(
        flat,
        lambda t: G.let(
            F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice(t, i * width + 1, F.lit(width))),
            lambda t: F.struct(
                t.alias("tokens"), F.transform(t, lambda x: x[0] != lit(PAD)).alias("mask"),
                F.greatest(F.lit(0), (F.size(poses) / 16).cast("int") * int(use_objects) + len(sides) - size).alias("dropped"),
            ),
        ),
    )


def add_tokens(
    training: DataFrame, mean: Sequence[float], std: Sequence[float], frame_mode: str = "camera_frame",
    sides: Sequence[str] = ("right",), use_objects: bool = True, reference: Column | None = None, size: int = MAX_TOKENS,
) -> DataFrame:
    """Tokens and mask of each training row, and how many entities found no place (D01, D02); no shuffle."""
    out = training.withColumn("_ref", reference if reference is not None else reference_inverse(frame_mode))
    t = tokens(F.col("_ref"), F.col("hands"), F.col("objects"), F.col("anchor_key"), mean, std, sides, use_objects, size)
    parts = {c: F.col(f"_t.{c}") for c in ("tokens", "mask", "dropped")}
    return out.withColumn("_t", t).withColumns(parts).drop("_t", "_ref")


def tokens_from_poses(
    rows: DataFrame, mean: Sequence[float], std: Sequence[float], side: str = "right", anchor_idx: int = 0
) -> DataFrame:
    """Tokens from poses already in the reference frame: ``hand``, ``grasp``, ``object_poses``."""
    named = F.map_from_entries(
        F.transform(
            "object_poses", lambda o, i: F.struct(F.format_string("%05d", i), F.struct(o.alias("T")))
        )
    )
    hands = F.create_map(F.lit(side), F.struct(F.col("hand").alias("T"), F.col("grasp").cast("double").alias("grasp")))
    eye = F.array(*[lit(v) for v in IDENTITY])
    t = tokens(eye, hands, named, F.lit(f"{anchor_idx:05d}"), mean, std, (side,))
    return rows.withColumn("_t", t).withColumns({"tokens": F.col("_t.tokens"), "mask": F.col("_t.mask")}).drop("_t")


def future_rows(samples: DataFrame, frames: DataFrame, horizon: int, stride: int = 1) -> DataFrame:
    """Frame ``t + k * stride`` of each sample for k = 1..horizon by numeric index; holes are null."""
    want = samples.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    want = want.withColumn("_f", F.col("frame_idx") + F.col("k") * stride)
    target = frames.select("episode", F.col("frame_idx").alias("_f"), F.struct("*").alias("future"))
    return want.join(target, ["episode", "_f"], "left").drop("_f")


def forward_fill(rows: DataFrame, columns: Sequence[str], zero: dict[str, Column], sample: Sequence[str]) -> DataFrame:
    """Missing steps repeat the step before; before the first known step they are zero.

    A horizon has at most a few dozen steps, so the window holds one sample.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*sample).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), zero[c]) for c in columns})


def targets(
    samples: DataFrame, frames: DataFrame, horizon: int, mean: Sequence[float], std: Sequence[float],
    frame_mode: str = "camera_frame", action: str = "absolute", side: str = "right", stride: int = 1,
    latch: bool = True, jitter: tuple[float, float, int] | None = None,
) -> DataFrame:
    """Action targets of each sample and step: hand 9 + grasp, object 9, done, 2-D trace.

    ``delta`` actions are relative to the first step with a pose. While the hand grasps, the object
    follows the hand with the offset of the first grasped step of the run (``latch``). ``jitter`` adds
    Gaussian noise (position metres, rotation degrees, seed) to the hand targets (D09).
    """
    from pyspark.sql import Window

    keys = ["episode", "frame_idx"]
    base = samples.select(*keys, reference_inverse(frame_mode).alias("_ref"), F.col("k").alias("_K"), "w", "h_px",
                          inverse(F.col("c2w")).alias("_w2c"), "anchor_key")
    rows = future_rows(base, frames, horizon, stride)
    hand = F.col("future.hands")[side]
    obj = F.get(F.transform(F.array(F.col("anchor_key")), lambda k: F.col("future.objects")[k]), F.lit(0))
    rows = rows.select(
        *keys, "k", "_ref", "_K", "w", "h_px", "_w2c",
        F.col("future").isNotNull().alias("_here"), hand["T"].alias("_hand"), hand["grasp"].alias("_g"),
        obj["T"].alias("_obj"), F.col("future.is_finished").alias("_done"),
    )
    w = Window.partitionBy(*keys).orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    grasped = F.col("_hand").isNotNull() & (F.col("_g") > 0.5) & F.col("_obj").isNotNull()
    # Steps whose frame or object is missing neither latch nor release.
    counted = F.col("_here") & F.col("_obj").isNotNull()
    rows = rows.withColumn("_on", grasped).withColumn(
        "_run", F.sum(F.when(counted & ~grasped, 1).otherwise(0)).over(whole)
    )
    first = Window.partitionBy(*keys, "_run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    lock = F.first(F.when(F.col("_on"), F.struct("_hand", "_obj")), ignorenulls=True).over(first)
    rows = rows.withColumn("_lock", lock)
    if latch:
        offset = relative(inverse(F.col("_lock._hand")), F.col("_lock._obj"))
        carried = F.when(F.col("_on"), relative(F.col("_hand"), offset)).otherwise(F.col("_obj"))
        rows = rows.withColumn("_obj", F.when(F.col("_obj").isNotNull(), carried))
    in_ref = lambda c: relative(F.col("_ref"), F.col(c))
    rows = rows.withColumns({"_h": in_ref("_hand"), "_o": in_ref("_obj")})
    if action == "delta":
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for c in ("_h", "_o"):
            rows = rows.withColumn("_first", F.first(c, ignorenulls=True).over(every))
            rows = rows.withColumn(c, relative(inverse(F.col("_first")), F.col(c)))
    elif action != "absolute":
        raise ValueError(f"unknown action mode: {action}")
    k9 = G.elements("_K", 9)
    seen = G.apply_pose("_w2c", G.translation("_hand"))
    uv = G.project(seen, k9, "unit", F.col("w"), F.col("h_px"))
    hand9 = lambda c: pose9(F.col(c), mean, std)
    rows = rows.withColumns(
        {
            "hand": hand9("_h"),
            "object": hand9("_o"),
            "grasp": F.when(F.col("_hand").isNotNull(), (F.col("_g") > 0.5).cast("double")),
            "trace": F.when(F.col("_hand").isNotNull(), F.array(uv["u"], uv["v"])),
            "done": F.when(F.col("_here"), F.coalesce(F.col("_done"), lit(0))),
        }
    )
    z9 = F.array(*[lit(0)] * 9)
    zero = {"hand": z9, "object": z9, "grasp": lit(0), "trace": F.array(lit(0), lit(0)), "done": lit(0)}
    rows = forward_fill(rows, list(zero), zero, keys).select(*keys, "k", *zero)
    if jitter is not None:
        pos, rot, seed = jitter
        noisy = [
            F.get("hand", F.lit(i)) + F.randn(seed + i) * lit(pos / std[i] if i < 3 else rot / 180.0) for i in range(9)
        ]
        rows = rows.withColumn("hand", F.array(*noisy))
    return rows


def action_arrays(rows: DataFrame) -> DataFrame:
    """One row per sample with the steps as an array ordered by k."""
    step = F.struct("k", "hand", "grasp", "object", "trace", "done")
    return rows.groupBy("episode", "frame_idx").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def anchor_pixel(training: DataFrame) -> DataFrame:
    """Normalised pixel of the anchor object, (0.5, 0.5) without one; the image size is 2 cx, 2 cy."""
    k = G.elements("k", 9)
    pose = F.get(F.transform(F.array("anchor_key"), lambda n: F.col("objects")[n]), F.lit(0))["T"]
    out = training.withColumns({"_a": pose, "_i": inverse(F.col("c2w"))})
    uv = G.project(G.apply_pose("_i", G.translation("_a")), k, "unit", k[2] * 2, k[5] * 2)
    ok = F.col("_a").isNotNull() & F.col("_i").isNotNull()
    uv = [F.when(ok, uv[c]).otherwise(lit(0.5)) for c in "uv"]
    return out.withColumn("anchor_uv", F.array(*uv)).drop("_a", "_i")


def future_tokens(
    samples: DataFrame, frames: DataFrame, horizon: int, mean: Sequence[float], std: Sequence[float],
    frame_mode: str = "camera_frame", sides: Sequence[str] = ("right",),
) -> DataFrame:
    """Tokens of frame t + horizon, or of t when it is missing, in the reference frame of t."""
    now = samples.withColumn("_r", reference_inverse(frame_mode))
    later = frames.select(
        "episode", (F.col("frame_idx") - horizon).alias("frame_idx"), F.struct("hands", "objects", "anchor_key").alias("_l")
    )
    rows = now.join(later, ["episode", "frame_idx"], "left")
    chosen = F.coalesce("_l", F.struct("hands", "objects", "anchor_key"))
    rows = rows.select("episode", "frame_idx", "_r", chosen.alias("_c")).select("episode", "frame_idx", "_r", "_c.*")
    return add_tokens(rows, mean, std, sides=sides, reference=F.col("_r")).select("episode", "frame_idx", "tokens", "mask")


def interpolated_tokens(
    training: DataFrame, alpha: Column, mean: Sequence[float], std: Sequence[float], cam: str = "cam0",
    sides: Sequence[str] = ("right",),
) -> DataFrame:
    """Tokens between a frame and the next one, in the interpolated reference frame.

    A token is kept only when it is valid in both frames; its type is not interpolated.
    """
    later = training.select(
        "episode", (F.col("frame_idx") - 1).alias("frame_idx"),
        F.struct("hands", "objects", "anchor_key", F.col(cam).alias("cam")).alias("_n"),
    )
    rows = training.join(later, ["episode", "frame_idx"]).withColumn("_alpha", alpha)
    ref = inverse(G.interpolate_pose(cam, "_n.cam", F.col("_alpha")))
    rows = rows.withColumn("_r", ref)
    now = tokens(F.col("_r"), F.col("hands"), F.col("objects"), F.col("anchor_key"), mean, std, sides)
    nxt = tokens(F.col("_r"), F.col("_n.hands"), F.col("_n.objects"), F.col("_n.anchor_key"), mean, std, sides)
    rows = rows.withColumns({"_a": now, "_b": nxt})

    def mix(a, b):
        valid = (a[0] != lit(PAD)) & (b[0] != lit(PAD))
        mixed = F.zip_with(a, b, lambda x, y: x + (y - x) * F.col("_alpha"))
        kept = F.concat(F.array(a[0]), F.slice(mixed, 2, F.size(mixed) - 1))
        return F.when(valid, kept).otherwise(F.transform(a, lambda x: lit(0)))

    mask = F.zip_with("_a.mask", "_b.mask", lambda x, y: x & y)
    return rows.select(
        "episode", "frame_idx", F.zip_with("_a.tokens", "_b.tokens", mix).alias("tokens"), mask.alias("mask")
    )


def safe_stride(samples: DataFrame, frames: DataFrame, horizon: int, largest: int = 3) -> DataFrame:
    """Largest stride s <= ``largest`` whose frame t + horizon * s exists, at least 1."""
    tries = samples.select("episode", "frame_idx", F.explode(F.sequence(F.lit(2), F.lit(largest))).alias("s"))
    there = frames.select("episode", F.col("frame_idx").alias("_f"))
    hit = tries.withColumn("_f", F.col("frame_idx") + F.col("s") * horizon).join(there, ["episode", "_f"], "left_semi")
    best = hit.groupBy("episode", "frame_idx").agg(F.max("s").alias("s"))
    out = samples.select("episode", "frame_idx").join(best, ["episode", "frame_idx"], "left")
    return out.select("episode", "frame_idx", F.coalesce("s", F.lit(1)).alias("stride"))


def position_stats(tokens_: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Mean and population deviation of the hand-token positions of all rows (A13): one pass with map-side sums.

    A caller who wants fewer rows samples them first.
    """
    hand = tokens_.select(F.explode(F.arrays_zip("tokens", "mask")).alias("t")).where(
        F.col("t.mask") & F.get("t.tokens", F.lit(0)).isin(HAND_LEFT, HAND_RIGHT)
    )
    axis = [F.get("t.tokens", F.lit(i)) for i in (1, 2, 3)]
    return hand.agg(
        *[F.avg(a).alias(f"mean_{n}") for a, n in zip(axis, "xyz")],
        *[F.greatest(F.stddev_pop(a), lit(floor)).alias(f"std_{n}") for a, n in zip(axis, "xyz")],
        F.count(F.lit(1)).alias("hand_tokens"),
    )


def zero_state_ratio(tokens_: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Share of rows whose first token has no position."""
    first = F.get("tokens", F.lit(0))
    size = sum((F.abs(F.get(first, F.lit(i))) for i in (2, 3)), F.abs(F.get(first, F.lit(1))))
    return tokens_.agg(F.avg((size <= eps).cast("double")).alias("zero_state_ratio"))


def decode_prediction(
    position: Column, six: Column, mean: Sequence[float], std: Sequence[float], bridge: Column,
    reference_in_camera: Column | None = None,
) -> Column:
    """Camera-frame end-effector pose of a predicted position and six-number rotation."""
    pos = G.unnormalise_position(position, [lit(v) for v in mean], [lit(v) for v in std])
    pose = G.let(F.array(*G.decode_6d(six)), lambda m: F.array(*G.from_parts(G.elements(m, 9), pos)))
    if reference_in_camera is not None:
        pose = relative(reference_in_camera, pose)
    return G.let(pose, lambda m: F.array(*G.compose(m, G.inverse_rigid(bridge))))
