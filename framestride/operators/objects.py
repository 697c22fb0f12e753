"""Object geometry: triangulation, refinement, depth lifting, principal axes, stereo hands, sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestride.functions import geometry as G
from framestride.functions import hands as H
from framestride.functions.geometry import lit
from framestride.functions.issues import check, explode_checks
from framestride.operators import series as S
from framestride.operators.bounds import dealt, fits
from framestride.operators.skew import exact_quantiles
from framestride.session import chunk_rows, stage

POINT = ("episode", "obj", "kpt")
_PAIRS4 = [(i, j) for i in range(4) for j in range(i, 4)]
_PAIRS3 = [(i, j) for i in range(3) for j in range(i, 3)]


def _symmetric(flat: np.ndarray, n: int, pairs) -> np.ndarray:
    m = np.zeros((len(flat), n, n))
    for c, (i, j) in enumerate(pairs):
        m[:, i, j] = m[:, j, i] = flat[:, c]
    return m


def _smallest_eigen(packed: pd.Series) -> pd.DataFrame:
    w, v = np.linalg.eigh(_symmetric(np.stack(packed.to_numpy()), 4, _PAIRS4))
    low = np.maximum(w[:, 0], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cond = np.where(low > 0, np.sqrt(w[:, 3] / low), 0.0)
    return pd.DataFrame({"x": list(v[:, :, 0]), "cond": cond})


def smallest_eigenvector(packed: Column) -> Column:
    """Eigenvector of the smallest eigenvalue of a symmetric 4x4 (10 numbers), and the condition number."""
    kind = T.StructType.fromDDL("x array<double>, cond double")
    return F.pandas_udf(_smallest_eigen, kind)(packed)


def _outer_sum(rows: Sequence[Sequence[Column]]) -> list[Column]:
    return [sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j]) for i, j in _PAIRS4]


def triangulate(views: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Linear triangulation of each point from all its visible views.

    ``views`` has ``u``, ``v``, ``vis``, the intrinsics ``k`` and the camera pose ``c2w``. Every view
    adds to a 4x4 normal matrix, so the aggregate is a plain sum with map-side combination. Points
    seen in fewer than two views are left out.
    """
    k = G.elements("k", 9)
    un, vn = (F.col("u") - k[2]) / k[0], (F.col("v") - k[5]) / k[4]
    seen = views.where(F.col("vis") != 0).withColumns(
        {"_un": un, "_vn": vn, "_p": F.array(*G.inverse_affine("c2w"))}
    )
    p = G.elements("_p", 16)
    rows = [[F.col("_un") * p[8 + j] - p[j] for j in range(4)], [F.col("_vn") * p[8 + j] - p[4 + j] for j in range(4)]]
    sums = _outer_sum(rows)
    total = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("views"), F.array(*[F.sum(s) for s in sums]).alias("_m")
    )
    out = total.where(F.col("views") >= 2).withColumn("_e", smallest_eigenvector(F.col("_m")))
    x = [F.get(F.col("_e.x"), F.lit(i)) for i in range(4)]
    return out.select(*keys, "views", *[(x[i] / x[3]).alias(c) for i, c in enumerate("xyz")], F.col("_e.cond").alias("cond"))


_BEHIND = 1e3  # fixed value: the residual of a view behind its camera


_FLAT = ["u", "v", "fx", "fy", "cx", "cy", *[f"w{i}" for i in range(12)]]


def _normal_sums(views: np.ndarray, x: np.ndarray, scale: float) -> np.ndarray:
    """Huber normal equations and cost of points in their views, one row of ten sums per view.

    ``views`` has the columns ``_FLAT`` (pixel, intrinsics, world-to-camera pose), ``x`` (n, 3) the point that each
    view looks at. A view with its point behind the camera costs two residuals of 1000 and has no gradient.
    """
    w = views[:, 6:].reshape(-1, 3, 4)
    c = np.einsum("nij,nj->ni", w[:, :, :3], x) + w[:, :, 3]
    ahead = c[:, 2] >= 1e-4
    z = np.where(ahead, c[:, 2], 1.0)
    out = np.zeros((len(x), 10))
    for axis in (0, 1):
        focal, middle = views[:, 2 + axis], views[:, 4 + axis]
        residual = np.where(ahead, focal * c[:, axis] / z + middle - views[:, axis], _BEHIND)
        slope = (focal / z)[:, None] * (w[:, axis, :3] - (c[:, axis] / z)[:, None] * w[:, 2, :3])
        slope = np.where(ahead[:, None], slope, 0.0)
        size = np.abs(residual)
        weight = np.where(size <= scale, 1.0, scale / np.maximum(size, scale))
        for n, (i, j) in enumerate(_PAIRS3):
            out[:, n] += weight * slope[:, i] * slope[:, j]
        out[:, 6:9] += (weight * residual)[:, None] * slope
        out[:, 9] += np.where(size <= scale, size * size / 2, scale * (size - scale / 2))
    return out


class _Descent:
    """Damped Gauss-Newton over many points at once: a trial is taken only if it lowers the cost."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x, self.trial = x.copy(), x.copy()
        self.sums, self.damping = np.full((n, 10), np.inf), np.full(n, 1e-3)
        self.done = ~np.isfinite(x).all(1)

    def take(self, sums: np.ndarray) -> None:
        """Judge the trials by their sums and set the next ones."""
        first = np.isinf(self.sums[:, 9])
        better = ~self.done & (sums[:, 9] < self.sums[:, 9])
        gain = np.where(first, np.inf, self.sums[:, 9] - sums[:, 9])
        small = better & (gain <= 1e-15 * (1 + sums[:, 9]))
        self.x[better], self.sums[better] = self.trial[better], sums[better]
        eased = np.where(first, self.damping, np.maximum(self.damping / 10, 1e-12))
        self.damping = np.where(better, eased, self.damping * 10)
        h = np.zeros((len(self.x), 3, 3))
        for n, (i, j) in enumerate(_PAIRS3):
            h[:, i, j] = h[:, j, i] = np.where(self.done, 0.0, self.sums[:, n])
        diagonal = np.einsum("nii->ni", h)
        diagonal += np.maximum(diagonal * self.damping[:, None], 1e-12)
        step = np.linalg.solve(h, np.where(self.done[:, None], 0.0, self.sums[:, 6:9])[:, :, None])[:, :, 0]
        self.trial = self.x - step
        self.done |= small | (np.abs(step).max(1) <= 1e-10 * (1 + np.abs(self.x).max(1))) | (self.damping > 1e12)


def _descend(views: np.ndarray, of: np.ndarray, x: np.ndarray, scale: float, steps: int) -> np.ndarray:
    """Refine points at once; ``of`` is the point of each view, in ascending order."""
    descent = _Descent(x)
    descent.done |= np.bincount(of, minlength=len(x)) == 0
    for _ in range(steps):
        if descent.done.all():
            break
        rows = ~descent.done[of]
        sums = np.zeros((len(x), 10))
        points, starts = np.unique(of[rows], return_index=True)
        sums[points] = np.add.reduceat(_normal_sums(views[rows], descent.trial[of[rows]], scale), starts)
        descent.take(sums)
    return descent.x


def refine_points(
    views: DataFrame, points: DataFrame, scale: float = 1.0, steps: int = 60, keys: Sequence[str] = POINT
) -> DataFrame:
    """Minimise the Huber reprojection error of each point.

    Damped Gauss-Newton with at most ``steps`` evaluations: a step counts only if the error falls, and a
    view whose camera has the point behind it costs a constant, so no point escapes behind a camera. Points
    with at most ``framestride.chunkRows`` views are refined in one pass over the views in order of their points, many
    points at once. The views of larger points are cut into blocks that sum up their normal equations in
    parallel; each evaluation of these points is one stage, and only their number passes through the driver.

    ``keys`` name a point once in ``points``. Views with a pixel that is null or not finite, or without
    intrinsics or pose, are left out; points without views keep their place, and points with a null
    coordinate stay as they are.
    """
    keys = list(keys)
    k = G.elements("k", 9)
    seen = views.where((F.col("vis") != 0) & (F.abs("u") < float("inf")) & (F.abs("v") < float("inf")))
    seen = seen.where(F.col("k").isNotNull() & F.col("c2w").isNotNull()).withColumn("_w", F.array(*G.inverse_affine("c2w")))
    flat = [F.col("u"), F.col("v"), k[0], k[4], k[2], k[5], *G.elements("_w", 12)]
    seen = seen.select(*keys, "frame_idx", *[c.cast("double").alias(n) for n, c in zip(_FLAT, flat)])
    start = points.select(*keys, *[F.col(c).cast("double").alias(c) for c in "xyz"])

    limit = chunk_rows(views)
    if fits(views, keys, limit):
        return _refine_in_order(seen, start, scale, steps, keys)
    large = stage(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)).drop("_n")
    if large.isEmpty():
        return _refine_in_order(seen, start, scale, steps, keys)
    small = _refine_in_order(seen.join(large, keys, "left_anti"), start.join(large, keys, "left_anti"), scale, steps, keys)
    return small.unionByName(_refine_in_blocks(seen.join(large, keys), start.join(large, keys), scale, steps, keys, limit))


def _refine_in_order(views: DataFrame, points: DataFrame, scale: float, steps: int, keys: list[str]) -> DataFrame:
    """Refine points whose views fit into one task each, as many at a time as come in one batch."""
    schema = points.schema

    def finished(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        seen = rows["u"].notna().to_numpy()
        of = np.cumsum(first) - 1
        out = rows[first][schema.names].reset_index(drop=True)
        x = _descend(rows.loc[seen, _FLAT].to_numpy(float), of[seen], out[["x", "y", "z"]].to_numpy(float), scale, steps)
        return out.assign(x=x[:, 0], y=x[:, 1], z=x[:, 2])

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            codes = np.column_stack([pd.factorize(rows[c], use_na_sentinel=False)[0] for c in keys])
            first = np.concatenate([[True], (codes[1:] != codes[:-1]).any(1)])
            last = np.flatnonzero(first)[-1]
            if last:
                yield finished(rows.iloc[:last], first[:last])
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield finished(held, np.arange(len(held)) == 0)

    joined = points.join(views, keys, "left").repartition(*keys).sortWithinPartitions(*keys)
    return joined.mapInPandas(run, schema)


def _refine_in_blocks(views: DataFrame, points: DataFrame, scale: float, steps: int, keys: list[str], limit: int) -> DataFrame:
    """The descent of points with many views: sums per block of views, then one judgement per point and evaluation."""
    kind = T.StructType.fromDDL("_x array<double>, _t array<double>, _s array<double>, _d double, _done boolean")
    views = stage(views.withColumn("_block", F.floor(F.col("frame_idx") / limit)))
    known = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    place = F.array("x", "y", "z")
    current = stage(points.select(
        *keys, place.alias("_x"), place.alias("_t"), F.array_repeat(lit(float("inf")), 10).alias("_s"), lit(1e-3).alias("_d"),
        (~known).alias("_done"),
    ))

    def sums(rows: pd.DataFrame, trial: pd.Series) -> pd.Series:
        return pd.Series(list(_normal_sums(rows.to_numpy(float), np.stack(trial.to_numpy()), scale)))

    def judge(x: pd.Series, t: pd.Series, s: pd.Series, d: pd.Series, new: pd.Series) -> pd.DataFrame:
        descent = _Descent(np.stack(x.to_numpy()))
        descent.trial, descent.sums, descent.damping = np.stack(t.to_numpy()), np.stack(s.to_numpy()), d.to_numpy(float)
        descent.take(np.stack(new.to_numpy()))
        columns = (list(descent.x), list(descent.trial), list(descent.sums), descent.damping, descent.done)
        return pd.DataFrame(dict(zip(kind.names, columns)))

    of_view, of_point = F.pandas_udf(sums, "array<double>"), F.pandas_udf(judge, kind)
    total = F.array(*[F.sum(F.get("_new", F.lit(i))) for i in range(10)]).alias("_new")
    for _ in range(steps):
        active = current.where("not _done")
        if active.isEmpty():
            break
        each = views.join(active.select(*keys, "_t"), keys).withColumn("_new", of_view(F.struct(*_FLAT), "_t"))
        block = each.groupBy(*keys, "_block").agg(total)
        judged = active.join(block.groupBy(*keys).agg(total), keys)
        judged = judged.withColumn("_j", of_point("_x", "_t", "_s", "_d", "_new")).select(*keys, "_j.*")
        current = stage(judged.unionByName(current.where("_done")))
    return current.select(*keys, *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def sample_views(views: DataFrame, step: int, start: int = 0, end: int | None = None) -> DataFrame:
    """Every ``step``-th frame of the range and its last frame."""
    last = views.groupBy("episode").agg(F.max("frame_idx").alias("_last"))
    rows = views.join(last, "episode")
    top = F.col("_last") if end is None else F.least(F.col("_last"), F.lit(end))
    first = F.least(F.lit(start), top)
    f = F.col("frame_idx")
    return rows.where((f >= first) & (f <= top) & (((f - first) % step == 0) | (f == top))).drop("_last")


def lift_points(rows: DataFrame, frames: int = 5, single: bool = False, keys: Sequence[str] = POINT) -> DataFrame:
    """Median of the first visible frames with a valid depth, or the first one.

    ``rows`` has ``u``, ``v``, ``vis``, ``depth``, ``k``, ``w``, ``h``. The rank filter is pushed
    below the shuffle by Spark, so only the first rows of each map task travel.
    """
    point = G.unproject(F.col("u"), F.col("v"), F.col("depth"), "k", F.col("w"), F.col("h"))
    ok = rows.where(F.col("vis") > 0).withColumn("_pt", point).where("_pt is not null")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("frame_idx"))
    first = ok.select(*keys, "frame_idx", "_pt").withColumn("_r", rank).where(F.col("_r") <= (1 if single else frames))
    axis = lambda i: F.median(F.get("_pt", F.lit(i)))  # noqa: E731  (at most `frames` rows per group)
    return first.groupBy(*keys).agg(*[axis(i).alias(c) for i, c in enumerate("xyz")], F.count(F.lit(1)).alias("used"))


def object_centres(points: DataFrame, keys: Sequence[str] = ("episode", "obj"), least: int = 3) -> DataFrame:
    """Mean of the keypoints; objects with fewer than ``least`` points get ``usable = false``."""
    return points.groupBy(*keys).agg(
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) >= least).alias("usable"),
    )


def scatter(points: DataFrame, keys: Sequence[str] = ("episode", "obj")) -> DataFrame:
    """Mean and scatter matrix of each point cloud, as plain sums."""
    names = "xyz"
    total = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"c{c}") for c in names],
        *[
            (F.covar_pop(names[i], names[j]) * F.count(F.lit(1))).alias(f"s{names[i]}{names[j]}")
            for i, j in _PAIRS3
        ],
    )
    return total


#: Image directions, and the names of the rules by (posture rule, anchor, case).
_RIGHT, _DOWN = np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])
RULES = {"pca1": False, "pca2": True}
_NAMES = np.array([
    [["context_aligned", "context_stacked"], ["anchor_symmetric", "anchor_elongated"]],
    [["horizontal_context", "vertical_context"], ["horizontal_anchor", "vertical_anchor"]],
])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sum(a * b, axis=-1, keepdims=True)


def _normalised(v: np.ndarray) -> np.ndarray:
    return v / (np.sqrt(_dot(v, v)) + 1e-12)


def _facing(v: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The vectors, turned round where they point away from a direction."""
    return np.where(_dot(v, direction) < 0, -v, v)


def principal_axes(
    values: np.ndarray, vectors: np.ndarray, aim: np.ndarray, is_anchor: np.ndarray, posture: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rotation matrices and rule names of all objects at once.

    ``values`` descend and the columns of ``vectors`` match; ``aim`` points from the object to the anchor. Two rules give
    the x and y axes: by variance, the anchor keeps its middle axis down and others their flat side; by posture
    (``posture``), the long axis is vertical or horizontal in the image.
    """
    long, middle, short = np.moveaxis(vectors, 2, 0)
    anchor = is_anchor[:, None]
    aim = np.where(anchor, _RIGHT, aim)

    y = _facing(np.where(anchor, middle, short), _DOWN)
    flat = lambda v: v - _dot(v, y) * y
    toward = flat(aim)
    stretched = anchor & ((values[:, :1] - values[:, 1:2]) / (values[:, :1] + 1e-12) > 0.15)
    stacked = ~anchor & (np.sqrt(_dot(toward, toward)) <= 1e-4)
    x = np.select([stretched, stacked], [_facing(long, _RIGHT), flat(np.broadcast_to(_RIGHT, y.shape))], toward)
    x = _normalised(flat(_normalised(x)))

    upright = np.abs(_dot(long, _DOWN)) > np.abs(_dot(long, _RIGHT))
    side = lambda d: np.where(np.abs(_dot(middle, d)) > np.abs(_dot(short, d)), middle, short)
    by_posture = posture[:, None]
    x = np.where(by_posture, _facing(np.where(upright, side(aim), long), aim), x)
    y = np.where(by_posture, _facing(np.where(upright, long, side(_DOWN)), _DOWN), y)
    case = np.where(by_posture, upright, stretched | stacked)[:, 0]
    names = _NAMES[posture.astype(int), is_anchor.astype(int), case.astype(int)]
    return np.stack([x, y, _normalised(np.cross(x, y))], axis=2), names


def object_frames(
    points: DataFrame, anchors: DataFrame, methods: DataFrame | None = None, default: str = "pca1"
) -> DataFrame:
    """Object pose from the principal axes of its points; the rule may differ per object.

    ``anchors`` names the anchor object per episode (``anchor_key``), ``methods`` the rule per ``obj``.
    Only the 3x3 scatter matrix of each object reaches Python. Where the recording names no anchor, or the anchor has no
    points, the other objects have no pose and ``error`` says why.
    """
    clouds = scatter(points)
    centre = F.array(*[F.col(f"c{c}") for c in "xyz"])
    clouds = clouds.withColumn("centre", centre).join(anchors, "episode", "left")
    anchor = clouds.where(F.col("obj") == F.col("anchor_key")).select("episode", F.col("centre").alias("anchor_centre"))
    rows = clouds.join(anchor, "episode", "left")
    if methods is not None:
        rows = rows.join(methods, "obj", "left")
    rule = F.coalesce(F.col("rule"), F.lit(default)) if methods is not None else F.lit(default)
    packed = F.array(*[F.col(f"s{'xyz'[i]}{'xyz'[j]}") for i, j in _PAIRS3])
    is_anchor = F.coalesce(F.col("obj") == F.col("anchor_key"), F.lit(False))
    error = F.when(F.col("anchor_key").isNull(), "no anchor named").when(~is_anchor & F.col("anchor_centre").isNull(), "anchor without points")
    other = F.when(~is_anchor, F.col("anchor_centre"))
    rows = rows.withColumn("error", error)

    def frames(scatter_: pd.Series, centre_: pd.Series, anchor_: pd.Series, is_anchor_: pd.Series, rule_: pd.Series, lost: pd.Series) -> pd.DataFrame:
        w, v = np.linalg.eigh(_symmetric(np.stack(scatter_.to_numpy()), 3, _PAIRS3))
        w, v = w[:, ::-1], v[:, :, ::-1]
        at = np.stack(centre_.to_numpy()).astype(float)
        to = np.stack([c if a is None else np.asarray(a, float) for a, c in zip(anchor_, at)])
        rotation, names = principal_axes(w, v, to - at, is_anchor_.to_numpy(bool), rule_.map(RULES).to_numpy(bool))
        pose = np.tile(np.eye(4), (len(w), 1, 1))
        pose[:, :3, :3], pose[:, :3, 3] = rotation, at
        known = ~lost.to_numpy(bool)
        poses = pd.Series(list(pose.reshape(-1, 16)), dtype=object).where(known, None)
        return pd.DataFrame({"T": poses, "rule": pd.Series(names, dtype=object).where(known, None), "spread": list(w)})

    kind = T.StructType.fromDDL("T array<double>, rule string, spread array<double>")
    udf = F.pandas_udf(frames, kind)
    return rows.withColumn("_f", udf(packed, "centre", other, is_anchor, rule, F.col("error").isNotNull())).select("episode", "obj", "n", "_f.*", "error")


# --- stereo ------------------------------------------------------------------------------------------


def _intersect(pairs: DataFrame, left: G.Elements, right: G.Elements) -> DataFrame:
    """Add ``_x``, the point whose images under two 3x4 projections (12 numbers each) are nearest to the pixels."""
    row = lambda c, p, i: [F.col(c) * p[8 + j] - p[4 * i + j] for j in range(4)]
    rows = [row("lu", left, 0), row("lv", left, 1), row("ru", right, 0), row("rv", right, 1)]
    out = pairs.withColumn("_e", smallest_eigenvector(F.array(*_outer_sum(rows))))
    h = [F.get(F.col("_e.x"), F.lit(i)) for i in range(4)]
    return out.withColumn("_x", F.when(F.abs(h[3]) > lit(1e-10), F.array(*[h[i] / h[3] for i in range(3)]))).drop("_e")


def _project(k: G.Elements, pose: G.Elements) -> G.Elements:
    """3x4 projection of intrinsics and a 4x4 pose, 12 numbers."""
    return [G.dot(k[3 * i : 3 * i + 3], [pose[j], pose[4 + j], pose[8 + j]]) for i in range(3) for j in range(4)]


def _gated(
    rows: DataFrame, left: G.Elements, right: G.Elements, kl: G.Elements, kr: G.Elements, m: G.Elements, *, reprojection_px=4.0,
    epipolar_px=6.0, min_depth=0.10, max_depth=2.0, min_ray_deg=0.5,
) -> DataFrame:
    """Add the errors and gates of a point given in both cameras; ``m`` maps left to right coordinates."""
    uv = {c: F.col(c) for c in ("lu", "lv", "ru", "rv")}

    def pixel_error(p, k, u, v):
        q = G.apply3(k, p)
        return F.when(F.abs(q[2]) > lit(1e-10), G.norm([q[0] / q[2] - u, q[1] / q[2] - v]))

    ray_l = G.apply3(G.inverse3(kl), [uv["lu"], uv["lv"], lit(1)])
    ray_r = G.apply3(G.transpose3(G.rotation(m)), G.apply3(G.inverse3(kr), [uv["ru"], uv["rv"], lit(1)]))
    out = rows.withColumns(
        {
            "left_z": left[2],
            "right_z": right[2],
            "left_error_px": pixel_error(left, kl, uv["lu"], uv["lv"]),
            "right_error_px": pixel_error(right, kr, uv["ru"], uv["rv"]),
            "epipolar_px": G.epipolar_distance(
                [uv["lu"], uv["lv"]], [uv["ru"], uv["rv"]], G.fundamental_matrix(kl, kr, m)
            ),
            "_l": F.array(*ray_l),
            "_r": F.array(*ray_r),
        }
    )
    a, b = G.vec("_l"), G.vec("_r")
    angle = F.degrees(F.acos(G.clamp(G.dot(a, b) / (G.norm(a) * G.norm(b)), -1, 1)))
    out = out.withColumn("ray_deg", angle).drop("_l", "_r")
    ok = (
        F.col("left_z").between(min_depth, max_depth)
        & F.col("right_z").between(min_depth, max_depth)
        & (F.col("left_error_px") <= reprojection_px)
        & (F.col("right_error_px") <= reprojection_px)
        & (F.col("epipolar_px") <= epipolar_px)
        & (F.col("ray_deg") >= min_ray_deg)
    )
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def triangulate_pairs(pairs: DataFrame, k_left: Column, k_right: Column, left_to_right: Column, **gates) -> DataFrame:
    """Two-view triangulation of ``lu, lv, ru, rv`` with all gates as columns.

    Adds the point in the left camera (``x, y, z``), both reprojection errors, the epipolar error, the
    ray angle and ``valid``. Rejected points keep their estimate. ``gates`` are the limits of :func:`_gated`.
    """
    kl, kr, m = G.elements(k_left, 9), G.elements(k_right, 9), G.elements(left_to_right, 16)
    p1 = [kl[3 * i + j] if j < 3 else lit(0) for i in range(3) for j in range(4)]
    out = _intersect(pairs, p1, _project(kr, m))
    out = out.withColumns({c: F.get("_x", F.lit(i)) for i, c in enumerate("xyz")}).drop("_x")
    left = [F.col(c) for c in "xyz"]
    return _gated(out, left, G.apply_pose(m, left), kl, kr, m, **gates).drop("left_z")


def triangulate_in_head(
    pairs: DataFrame, k_left: Column, k_right: Column, left_to_head: Column, right_to_head: Column, raw_to_image: Column, **gates
) -> DataFrame:
    """Two-view triangulation with the projections of two cameras mounted on a head (F17, second form).

    ``left_to_head`` and ``right_to_head`` are the poses of the raw cameras, ``raw_to_image`` the change of
    axes to the image cameras, columns of the rows (a session's calibration). Adds the point in head coordinates (``x, y, z``), in both image cameras
    (``left_xyz``, ``right_xyz``), and the errors and gates of :func:`triangulate_pairs`. Null pixels or
    poses give null points that are not valid.
    """
    out = pairs.withColumns({"_kl": k_left, "_kr": k_right, "_el": left_to_head, "_er": right_to_head, "_b": raw_to_image})
    for step in (  # one column per step, so that no expression repeats the one before it
        lambda e: {f"_i{e}": G.inverse_affine(f"_e{e}")},
        lambda e: {f"_h{e}": G.compose(G.from_parts(G.elements("_b", 9), [lit(0)] * 3), f"_i{e}")},
        lambda e: {f"_p{e}": _project(G.elements(f"_k{e}", 9), G.elements(f"_h{e}", 16)), f"_v{e}": G.inverse_affine(f"_h{e}")},
    ):
        out = out.withColumns({c: F.array(*v) for e in "lr" for c, v in step(e).items()})
    out = out.withColumn("_m", F.array(*G.compose("_hr", "_vl")))
    out = _intersect(out, G.elements("_pl", 12), G.elements("_pr", 12))
    out = out.withColumns({c: F.get("_x", F.lit(i)) for i, c in enumerate("xyz")})
    known = F.col("_x").isNotNull()
    out = out.withColumns(
        {
            name: F.when(known, F.array(*G.apply_pose(G.elements(pose, 16), G.vec("_x"))))
            for name, pose in (("left_xyz", "_hl"), ("right_xyz", "_hr"))
        }
    )
    out = _gated(out, G.vec("left_xyz"), G.vec("right_xyz"), G.elements("_kl", 9), G.elements("_kr", 9), G.elements("_m", 16), **gates)
    return out.drop(*[f"_{c}{e}" for c in "keihpv" for e in "lr"], "_b", "_m", "_x", "left_z", "right_z")


def candidate_pairs(hands: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Left and right detections of the same frame and side, both confident, both with 21 joints."""
    good = hands.where((F.col("score") >= confidence) & (F.size("uv") == 21))
    # Dealt by measured rows: the rows are few bytes for the work that pairs of points are, and keep this place to the end.
    eye = lambda name: dealt(good.where(F.col("eye") == name).select(
        "episode", "frame_idx", "side", F.col("hand_id").alias(f"{name}_id"), F.col("score").alias(f"{name}_score"),
        F.col("uv").alias(f"{name}_uv"),
    ), ["episode", "frame_idx", "side"])
    return eye("left").join(eye("right"), ["episode", "frame_idx", "side"])


def _pixels_to_points(
    uv: np.ndarray, k: np.ndarray, m: np.ndarray, *, reprojection_px=4.0, epipolar_px=6.0, min_depth=0.10, max_depth=2.0, min_ray_deg=0.5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formulas of :func:`triangulate_pairs` over whole arrays: points (n, 3), epipolar errors and gates.

    ``uv`` (n, 4) holds ``lu, lv, ru, rv``, ``k`` (3, 3) the intrinsics of both cameras, ``m`` (4, 4) left to right. Rows
    without all pixels, and points at infinity, are NaN and not valid.
    """
    known = np.isfinite(uv).all(1)
    projections = np.column_stack([k, np.zeros(3)]), k @ m[:3]
    rows = np.stack([uv[:, i, None] * projections[i // 2][2] - projections[i // 2][i % 2] for i in range(4)], axis=1)
    normal = np.where(known[:, None, None], np.swapaxes(rows, 1, 2) @ rows, np.eye(4))
    h = np.linalg.eigh(normal)[1][:, :, 0]
    turn, back = m[:3, :3], np.linalg.inv(k)
    x, y, z = m[:3, 3]
    fundamental = back.T @ np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) @ turn @ back
    pixels = [np.column_stack([uv[:, c : c + 2], np.ones(len(uv))]) for c in (0, 2)]
    with np.errstate(all="ignore"):
        points = np.where((known & (np.abs(h[:, 3]) > 1e-10))[:, None], h[:, :3] / h[:, 3:], np.nan)
        places = points, points @ turn.T + m[:3, 3]
        lines = pixels[0] @ fundamental.T, pixels[1] @ fundamental
        residual = np.abs(np.sum(pixels[1] * lines[0], axis=1))
        epipolar = residual / 2 * sum(1 / np.maximum(np.hypot(*line[:, :2].T), 1e-12) for line in lines)
        rays = pixels[0] @ back.T, pixels[1] @ back.T @ turn
        cosine = np.sum(rays[0] * rays[1], axis=1) / np.prod([np.sqrt(_dot(r, r))[:, 0] for r in rays], axis=0)
        ok = (np.degrees(np.arccos(np.clip(cosine, -1, 1))) >= min_ray_deg) & (epipolar <= epipolar_px)
        for place, pixel in zip(places, pixels):
            q = place @ k.T
            error = np.hypot(*(q[:, :2] / q[:, 2:] - pixel[:, :2]).T)
            ok &= (np.abs(q[:, 2]) > 1e-10) & (place[:, 2] >= min_depth) & (place[:, 2] <= max_depth) & (error <= reprojection_px)
    return points, epipolar, ok


def pair_points(pairs: DataFrame, k: Column, left_to_right: Column, **gates) -> DataFrame:
    """Triangulate the 21 joints of each candidate pair; cost = median + wrist epipolar error.

    All joints of a batch of pairs go through one call (:func:`_pixels_to_points`); a pair stays one row. ``k`` and
    ``left_to_right`` are the same for all pairs, or follow from their ids.
    """
    ids = ["episode", "frame_idx", "side", "left_id", "right_id"]
    at = lambda c, i: F.get(c, F.lit(i))
    flat = F.transform(
        F.arrays_zip("left_uv", "right_uv"), lambda q: F.array(*[at(q[c], i).cast("double") for c in ("left_uv", "right_uv") for i in (0, 1)])
    )
    # Rows that share all ids are one candidate of more joints.
    there = F.col("left_uv").isNotNull() & F.col("right_uv").isNotNull() & (F.greatest(F.size("left_uv"), F.size("right_uv")) > 0)
    rows = pairs.where(there).select(*ids, F.flatten(flat).alias("_uv")).groupBy(*ids).agg(F.collect_list("_uv").alias("_uv"))
    rows = rows.withColumns({"_k": k.cast("array<double>"), "_m": left_to_right.cast("array<double>")})

    def solve(uv: pa.Array, k: pa.Array, m: pa.Array) -> pa.Array:
        numbers = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
        own = uv.flatten()
        sizes, lengths = pc.list_value_length(uv).to_numpy(), pc.list_value_length(own).to_numpy() // 4
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]  # of the joints of each row
        joint = np.arange(ends[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        of = np.repeat(np.arange(len(uv)), np.diff(ends))
        pixels, points = numbers(own.flatten()).reshape(-1, 4), np.empty((len(of), 3))
        epipolar, ok = np.empty(len(of)), np.empty(len(of), bool)
        rigs, rig = np.unique(np.column_stack([numbers(k.flatten()).reshape(-1, 9), numbers(m.flatten()).reshape(-1, 16)]), axis=0, return_inverse=True)
        for n, camera in enumerate(rigs):
            mine = np.flatnonzero(rig.ravel()[of] == n)
            points[mine], epipolar[mine], ok[mine] = _pixels_to_points(pixels[mine], camera[:9].reshape(3, 3), camera[9:].reshape(4, 4), **gates)
        cost = np.full(len(uv), np.nan)
        whole = (np.diff(ends) == 21) & (np.bincount(of, np.isnan(epipolar), len(uv)) == 0) & (sizes == 1)
        some = epipolar[whole[of]].reshape(-1, 21)
        cost[whole] = np.median(some, axis=1) + some[:, 0]
        for row in np.flatnonzero(~whole):
            mine = slice(ends[row], ends[row + 1])
            errors = epipolar[mine][~np.isnan(epipolar[mine])]
            wrists = epipolar[mine][(joint[mine] == 0) & ~np.isnan(epipolar[mine])]
            if len(wrists):
                cost[row] = np.median(errors) + wrists.max()
        nullable = lambda a: pa.array(a, pa.float64(), mask=np.isnan(a))
        if sizes.max(initial=1) > 1:
            order = np.lexsort((ok, *points.T[::-1], joint, of))
            points, ok = points[order], ok[order]
        places = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1, dtype=np.int32) * 3), nullable(points.ravel()))
        bounds = pa.array(ends.astype(np.int32))
        found = [nullable(cost), pa.ListArray.from_arrays(bounds, places), pa.ListArray.from_arrays(bounds, pa.array(ok))]
        return pa.StructArray.from_arrays(found, ["cost_px", "points", "valid"])

    solved = F.arrow_udf(solve, "cost_px double, points array<array<double>>, valid array<boolean>")
    return rows.withColumn("_s", solved("_uv", "_k", "_m")).select(*ids, "_s.*")


def unique_matches(pairs: DataFrame, margin_px: float = 2.0, require_full: bool = True) -> DataFrame:
    """Keep a candidate only if it beats every competitor by the margin; then the hand gates.

    Competitors are the other candidates of the same frame and side: a shared left or right hand
    implies the same side. Each candidate is judged by its own points.
    """
    w = Window.partitionBy("episode", "frame_idx", "side")
    by_cost = w.orderBy("cost_px", "left_id", "right_id")
    # The cheapest other candidate: the next one for the first, the first one for the rest.
    rival = F.when(F.row_number().over(by_cost) == 1, F.lead("cost_px").over(by_cost)).otherwise(
        F.min("cost_px").over(w)
    )
    gate = F.arrow_udf(H.gates(require_full), "boolean")(F.col("points").cast("array<array<double>>"), F.col("valid"))
    out = pairs.withColumn("_gate", gate).withColumn("_rival", rival)
    unique = F.coalesce(F.col("cost_px") + margin_px < F.col("_rival"), F.lit(True))
    # The rejection codes.
    reason = F.when(~unique, "ambiguous_correspondence").when(~F.col("_gate"), "joint_or_hand_quality")
    return out.withColumn("rejection", reason).withColumn("accepted", F.col("rejection").isNull()).drop("_rival", "_gate")


def handedness_pairs(hands: DataFrame) -> DataFrame:
    """Best detection per side and eye, whether both eyes have one, and ambiguity."""
    eye = lambda e: F.col("eye") == e
    best = lambda e: F.max_by(F.col("hand_id"), F.when(eye(e), F.struct("score", -F.col("hand_id"))))
    out = hands.groupBy("episode", "frame_idx", "side").agg(
        best("left").alias("left_id"),
        best("right").alias("right_id"),
        F.count_if(eye("left")).alias("_nl"),
        F.count_if(eye("right")).alias("_nr"),
    )
    return out.select(
        "episode", "frame_idx", "side", "left_id", "right_id",
        ((F.col("_nl") > 0) & (F.col("_nr") > 0)).alias("matched"),
        ((F.col("_nl") > 1) | (F.col("_nr") > 1)).alias("ambiguous"),
        F.lit(False).alias("geometry_verified"),
    )


def detection_summary(frames: DataFrame, hands: DataFrame, pairs: DataFrame) -> DataFrame:
    """Detections per eye, candidate pairs and share of frames without a hand."""
    per_frame = hands.groupBy("episode", "frame_idx").agg(
        F.count_if(F.col("eye") == "left").alias("left"), F.count_if(F.col("eye") == "right").alias("right")
    )
    matched = pairs.where("matched").groupBy("episode").agg(F.count(F.lit(1)).alias("candidate_pairs"))
    every = frames.select("episode", "frame_idx").join(per_frame, ["episode", "frame_idx"], "left")
    none = lambda c: F.avg((F.coalesce(F.col(c), F.lit(0)) == 0).cast("double"))
    return (
        every.groupBy("episode")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.coalesce(F.sum("left"), F.lit(0)).alias("left_detections"),
            F.coalesce(F.sum("right"), F.lit(0)).alias("right_detections"),
            none("left").alias("left_no_hand_ratio"),
            none("right").alias("right_no_hand_ratio"),
        )
        .join(matched, "episode", "left")
        .withColumn("candidate_pairs", F.coalesce("candidate_pairs", F.lit(0)))
    )


def variant_diagnostics(joints: DataFrame) -> DataFrame:
    """Valid-joint share, median epipolar error and disparity per geometry variant.

    ``joints``: one row per candidate joint with ``variant``, ``valid``, ``epipolar_px``,
    ``disparity_px``, ``left_error_px``, ``right_error_px``.
    """
    keys = ["variant"]
    base = joints.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("joints"),
        F.avg(F.col("valid").cast("double")).alias("valid_ratio"),
        F.avg("left_error_px").alias("left_mean_px"),
        F.avg("right_error_px").alias("right_mean_px"),
    )
    for column, name in (
        ("epipolar_px", "epipolar_median_px"),
        ("disparity_px", "disparity_median_px"),
        ("left_error_px", "left_median_px"),
        ("right_error_px", "right_median_px"),
    ):
        base = base.join(exact_quantiles(joints, keys, column, [0.5], [name]), keys, "left")
    return base


def joint_errors(joints: DataFrame) -> DataFrame:
    """Mean reprojection error per variant and joint."""
    return joints.groupBy("variant", "joint").agg(
        F.avg("left_error_px").alias("left_mean_px"), F.avg("right_error_px").alias("right_mean_px")
    )


# --- reprojection audit -------------------------------------------------------------------------------


def adapter_points(frames: DataFrame, adapter: Callable[[dict], dict], columns: Sequence[str]) -> DataFrame:
    """Points of a user function per frame, failures as ``error`` text.

    ``adapter`` gets the row as a dict and returns ``points`` (N x 3) and optionally ``pixels`` (N x 2).
    """
    columns = list(columns)
    kind = frames.select("episode", "frame_idx").schema
    schema = T.StructType(
        kind.fields
        + T.StructType.fromDDL("points array<array<double>>, pixels array<array<double>>, error string").fields
    )

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                points = pixels = error = None
                try:
                    got = adapter({c: row[c] for c in columns})
                    points = np.asarray(got["points"], float).reshape(-1, 3).tolist()
                    if got.get("pixels") is not None:
                        pixels = np.asarray(got["pixels"], float).reshape(-1, 2).tolist()
                except Exception as e:  # a failing adapter becomes a row, not a failed job
                    error = f"{type(e).__name__}: {e}"
                out.append((row["episode"], row["frame_idx"], points, pixels, error))
            yield pd.DataFrame(out, columns=schema.names)

    return frames.select(*dict.fromkeys(["episode", "frame_idx", *columns])).mapInPandas(run, schema)


def adapter_issues(frames: DataFrame) -> DataFrame:
    """Warning rows for frames whose adapter failed, and for those with points of which none is in front.

    ``frames`` has the columns of :func:`adapter_points`, and ``c2w`` for the second check.
    """
    checks = [
        check(F.col("error").isNotNull(), "warning", "reprojection", "adapter", F.col("error"), "no error", "The point adapter failed")
    ]
    if "c2w" in frames.columns:
        depth = lambda p: G.apply_pose(G.inverse_affine("c2w"), p)[2]
        behind = (F.size("points") > 0) & ~F.exists("points", lambda p: F.coalesce(depth(p) > 0, F.lit(False)))
        checks.append(
            check(F.col("error").isNull() & behind, "warning", "reprojection", "points_in_front", F.lit(0), ">=1", "No point lies in front of the camera")
        )
    return explode_checks(frames, checks)


def reprojection_summary(frames: DataFrame) -> DataFrame:
    """Per frame: points, points in front, mean pixel, mean and 95th percentile error.

    Input: ``points`` (world), optional ``pixels`` of the same length, ``c2w`` and ``k``.
    """
    exploded = frames.select(
        "episode", "frame_idx", "c2w", "k", F.posexplode("points").alias("i", "p"), "pixels"
    ).withColumn("gt", F.get("pixels", F.col("i")))
    exploded = exploded.withColumn("_c", F.array(*G.apply_pose(G.inverse_affine("c2w"), "p")))
    uv = G.project("_c", "k", "front")
    rows = exploded.withColumn("uv", uv)
    ok = F.col("uv.valid")
    error = G.norm([F.col("uv.u") - F.get("gt", F.lit(0)), F.col("uv.v") - F.get("gt", F.lit(1))])
    rows = rows.withColumn("error_px", F.when(ok, error))
    base = rows.groupBy("episode", "frame_idx").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(ok).alias("in_front"),
        F.avg(F.when(ok, F.col("uv.u"))).alias("mean_u"),
        F.avg(F.when(ok, F.col("uv.v"))).alias("mean_v"),
        F.avg("error_px").alias("mean_error_px"),
    )
    tail = exact_quantiles(rows, ["episode", "frame_idx"], "error_px", [0.95], ["p95_error_px"])
    return base.join(tail, ["episode", "frame_idx"], "left")


# --- sampling ------------------------------------------------------------------------------------------


def even_sample(df: DataFrame, n: int, keys: Sequence[str], order: str) -> DataFrame:
    """``n`` evenly spaced rows of each series: positions of linspace(0, rows - 1, n), truncated."""
    out = S.scan(df, keys, order, [S.position("_pos"), S.total("_rows", F.count(F.lit(1)))])
    # Row p is chosen as often as there are j with floor(j * (rows - 1) / (n - 1)) = p.
    last = F.col("_rows") - 1
    low = F.ceil(F.col("_pos") * (n - 1) / F.when(last > 0, last)).cast("long")
    high = F.ceil((F.col("_pos") + 1) * (n - 1) / F.when(last > 0, last)).cast("long") - 1
    low = F.when(last == 0, F.lit(0)).otherwise(low)
    high = F.when(last == 0, F.lit(n - 1)).when(F.col("_pos") == last, F.lit(n - 1)).otherwise(high)
    picks = F.when(high >= low, F.sequence(low, high))
    return out.withColumn("sample", F.explode(picks)).drop("_pos", "_rows")


def resample_points(points: Column, n: int = 64, seed: int = 0) -> Column:
    """Exactly ``n`` points: an even subset of a larger set, random repeats of a smaller one."""
    size = F.size(points)
    even = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(points, F.floor(j * (size - 1) / F.lit(n - 1.0)).cast("int"))
    )
    draw = lambda j: F.pmod(F.xxhash64(F.lit(seed), j, points), size).cast("int")
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(points, F.when(j < size, j).otherwise(draw(j)))
    )
    zero = F.array_repeat(F.array(lit(0), lit(0), lit(0)), n)
    return F.when(F.coalesce(size, F.lit(0)) <= 0, zero).when(size >= n, even).otherwise(padded)


def contour_samples(contour: DataFrame, n: int, keys: Sequence[str] = ("episode", "obj"), order: str = "i") -> DataFrame:
    """``n`` points evenly spaced along a closed contour, starting at its top-most point."""
    keys = list(keys)
    top = F.struct("y", "x", order)
    rows = S.scan(
        contour, keys, order, [S.total("_n", F.count(F.lit(1))), S.total("_top", F.min(top), F.min), S.position("_p")]
    )
    rows = rows.withColumn("_start", F.when(F.col(order) == F.col(f"_top.{order}"), F.col("_p")))
    rows = S.scan(rows, keys, order, [S.total("_first", F.max("_start"), F.max)])
    rows = rows.withColumn("_q", F.pmod(F.col("_p") - F.col("_first"), F.col("_n")))
    here = F.struct("x", "y")
    rows = S.scan(rows, keys, "_q", [S.lead("_next", here), S.of_first("_origin", here)])
    rows = rows.withColumn("_to", F.coalesce("_next", "_origin"))
    length = F.sqrt((F.col("_to.x") - F.col("x")) ** 2 + (F.col("_to.y") - F.col("y")) ** 2)
    rows = rows.withColumn("_len", length)
    rows = S.scan(rows, keys, "_q", [S.running_sum("_end", "_len"), S.total("_total", F.sum("_len"))])
    # The end of one piece is the begin of the next, so every target falls into exactly one.
    rows = S.scan(rows, keys, "_q", [S.lag("_begin", "_end")]).withColumn("_begin", F.coalesce("_begin", lit(0)))
    # Targets t = j * total / n with begin < t <= end; the first piece also takes t = 0.
    unit = F.col("_total") / F.lit(n)
    first = F.when(F.col("_q") == 0, F.lit(0)).otherwise(F.floor(F.col("_begin") / unit).cast("long") + 1)
    last = F.least(F.floor(F.col("_end") / unit).cast("long"), F.lit(n - 1))
    picked = rows.withColumn("sample", F.explode(F.when(last >= first, F.sequence(first, last))))
    t = F.col("sample") * unit
    share = F.when(F.col("_len") > 0, (t - F.col("_begin")) / F.col("_len")).otherwise(lit(0))
    point = [F.rint(F.col(c) + share * (F.col(f"_to.{c}") - F.col(c))).cast("int").alias(c) for c in "xy"]
    return picked.select(*keys, "sample", *point)
