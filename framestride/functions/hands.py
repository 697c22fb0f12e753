"""Hand geometry on 21-point skeletons: frames, joint angles, reorderings, gates, confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.functions.geometry import lit

# 21-point detector order to 21-point skeleton order; point 20 is the palm centre.
DETECTOR_TO_SKELETON = (4, 8, 12, 16, 20, 0, 2, 3, 5, 6, 7, 9, 10, 11, 13, 14, 15, 17, 18, 19)
PALM_POINTS = (0, 5, 9)
# 26-joint headset order to 21-point skeleton order.
HEADSET_TO_SKELETON = (5, 10, 15, 20, 25, 1, 2, 3, 6, 7, 9, 11, 12, 14, 16, 17, 19, 21, 22, 24, 0)
# Bones of the detector order, and the joints that define the hand frame.
BONES = (
    (0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (11, 12),
    (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20),
)
FRAME_JOINTS = (0, 2, 4, 5, 8, 17)
# Metacarpal, proximal, intermediate joint and tip of each finger in the skeleton order.
FINGERS = {"Index": (8, 9, 10, 1), "Middle": (11, 12, 13, 2), "Ring": (14, 15, 16, 3), "Pinky": (17, 18, 19, 4)}
MEAN_PALM_M = 0.085


def point(points: Column | str, i: int) -> list[Column]:
    points = F.col(points) if isinstance(points, str) else points
    p = F.get(points, F.lit(i))
    return [F.get(p, F.lit(j)) for j in range(3)]


def distance(points: Column | str, a: int, b: int) -> Column:
    return G.norm(G.sub(point(points, a), point(points, b)))


def detector_to_skeleton(points: Column) -> Column:
    """Reorder 21 detector points; the palm centre is the mean of three joints."""
    moved = [F.get(points, F.lit(i)) for i in DETECTOR_TO_SKELETON]
    a, b, c = (point(points, i) for i in PALM_POINTS)
    palm = F.array(*[(x + y + z) / 3 for x, y, z in zip(a, b, c)])
    return F.array(*moved, palm)


def headset_to_skeleton(points: Column) -> Column:
    """Reorder 26 headset joints."""
    return F.array(*[F.get(points, F.lit(i)) for i in HEADSET_TO_SKELETON])


def tip_distance(points: Column, thumb: int = 0, index: int = 1) -> Column:
    """Distance of thumb and index tips."""
    return distance(points, thumb, index)


def opening_ratio(points: Column) -> Column:
    """Tip gap over palm width, detector order."""
    return distance(points, 4, 8) / distance(points, 5, 17)


def status_confidence(status: Column, bit: int = 8) -> Column:
    """1 when every joint has the tracked bit, else 0."""
    return F.when(F.forall(status, lambda s: F.coalesce(s, F.lit(0)).bitwiseAND(F.lit(bit)) != 0), 1.0).otherwise(0.0)


def _columns_to_rotation(x, y, z) -> list[Column]:
    return [c[i] for i in range(3) for c in (x, y, z)]


def gripper_frame(wrist, thumb_base, index_base, thumb_tip, index_tip) -> Column:
    """4x4 midpoint frame with fixed fallback axes when a direction degenerates."""
    arm = [(a + b) / 2 - w for a, b, w in zip(thumb_base, index_base, wrist)]
    middle = [(a + b) / 2 for a, b in zip(thumb_tip, index_tip)]

    def with_z(x, z):
        return G.bind(
            G.unit_or(G.cross(z, x), (0, 1, 0)),
            lambda y: F.array(*G.from_parts(_columns_to_rotation(x, y, z), middle)),
        )

    def with_x(x):
        y_raw = G.sub(arm, G.scale(x, G.dot(arm, x)))
        return G.bind(
            y_raw,
            lambda raw: G.bind(
                G.unit_or(raw, (0, 1, 0)),
                lambda y: G.bind(G.unit_or(G.cross(x, y), (0, 0, 1)), lambda z: with_z(x, z)),
            ),
        )

    return G.bind(G.unit_or(G.sub(index_base, thumb_base), (1, 0, 0)), with_x)


def _unit_or_null(v, eps: float) -> list[Column]:
    n = G.norm(v)
    return [F.when(n > lit(eps), x / n) for x in v]


def gripper_rotation_or_null(wrist, thumb_base, index_base, eps: float = 1e-6, eps_arm: float = 1e-4) -> Column:
    """3x3 midpoint rotation, null when degenerate: the caller keeps the previous one."""
    x_raw = G.sub(index_base, thumb_base)
    arm = [(a + b) / 2 - w for a, b, w in zip(thumb_base, index_base, wrist)]

    def with_x(x):
        def with_y(raw):
            ok = (G.norm(x_raw) > lit(eps)) & (G.norm(arm) >= lit(eps_arm)) & (G.norm(raw) > lit(eps))
            rot = G.bind(_unit_or_null(raw, eps), lambda y: F.array(*_columns_to_rotation(x, y, G.cross(x, y))))
            return F.when(ok, rot)

        return G.bind(G.sub(arm, G.scale(x, G.dot(arm, x))), with_y)

    return G.bind(_unit_or_null(x_raw, eps), with_x)


def normal_frame(position, normal, forward) -> Column:
    """4x4 frame with z along a unit surface normal and y close to a forward direction."""
    return G.bind(
        G.unit(G.cross(forward, normal), 1e-6),
        lambda x: G.bind(
            G.unit(G.cross(normal, x), 1e-6),
            lambda y: F.array(*G.from_parts(_columns_to_rotation(x, y, normal), position)),
        ),
    )


def wrist_and_palm(palm_normal, palm, wrist_normal, wrist) -> tuple[Column, Column]:
    """Wrist and palm poses from positions and normals; null when a normal is zero."""
    ok = (G.norm(wrist_normal) != 0) & (G.norm(palm_normal) != 0)

    def build(position, normal):
        frame = G.bind(
            G.unit(G.sub(palm, wrist), 1e-6),
            lambda f: G.bind(G.unit(normal, 1e-6), lambda n: normal_frame(position, n, f)),
        )
        return F.when(ok, frame)

    return build(wrist, wrist_normal), build(palm, palm_normal)


def _angle(a, b) -> Column:
    """Angle between two vectors in degrees; 1e-6 is added to each norm."""
    return G.bind(
        [*a, *b],
        lambda v: F.degrees(
            F.acos(
                G.clamp(
                    G.dot(v[:3], v[3:]) / ((G.norm(v[:3]) + lit(1e-6)) * (G.norm(v[3:]) + lit(1e-6))), -1, 1
                )
            )
        ),
    )


def joint_angles(points: Column) -> Column:
    """Twenty flexion and abduction angles in degrees as a map; empty without 21 points."""
    p = lambda i: point(points, i)
    bone = lambda a, b: G.sub(p(b), p(a))

    def angles(normal) -> Column:
        def abduction(v):
            flat = lambda u: G.sub(u, G.scale(normal, G.dot(u, normal)))
            return _angle(flat(v), flat(bone(11, 12)))

        out: dict[str, Column] = {}
        for name, (mcp, pip, dip, tip) in FINGERS.items():
            out[f"{name}_MCP_Flex"] = _angle(bone(5, mcp), bone(mcp, pip))
            out[f"{name}_PIP_Flex"] = _angle(bone(mcp, pip), bone(pip, dip))
            out[f"{name}_DIP_Flex"] = _angle(bone(pip, dip), bone(dip, tip))
            out[f"{name}_MCP_Abd"] = lit(0) if name == "Middle" else abduction(bone(mcp, pip))
        out["Thumb_CMC_Flex"] = _angle(bone(5, 11), bone(5, 6))
        out["Thumb_CMC_Abd"] = abduction(bone(5, 6))
        out["Thumb_MCP_Flex"] = _angle(bone(5, 6), bone(6, 7))
        out["Thumb_IP_Flex"] = _angle(bone(6, 7), bone(7, 0))
        return F.create_map(*[x for k, v in out.items() for x in (F.lit(k), v)])

    full = G.bind(G.unit(G.cross(bone(5, 8), bone(5, 11)), 1e-6), angles)
    return F.when(F.size(points) >= 21, full).otherwise(F.expr("cast(map() as map<string,double>)"))


def absolute_points(uv: Column, relative: Column, k) -> Column:
    """Camera points from pixel and hand-centred points, by apparent palm size.

    Null when the palm is smaller than 5 pixels or the depth is outside 0.05 to 3 m.
    """
    k = G.elements(k, 9)
    w2, m2 = F.get(uv, F.lit(0)), F.get(uv, F.lit(9))
    at = lambda p, i: F.get(p, F.lit(i))
    measured = distance(relative, 0, 9)
    physical = F.when(measured < lit(0.01), lit(MEAN_PALM_M)).otherwise(measured)
    pixels = G.norm([at(m2, 0) - at(w2, 0), at(m2, 1) - at(w2, 1)])
    z = (k[0] + k[4]) / 2 * physical / pixels
    ok = (pixels >= 5) & (z >= lit(0.05)) & (z <= lit(3.0))
    wrist = [(at(w2, 0) - k[2]) * z / k[0], (at(w2, 1) - k[5]) * z / k[4], z]
    origin = point(relative, 0)
    moved = F.transform(
        relative,
        lambda p: F.array(
            wrist[0] + at(p, 0) - origin[0],
            wrist[1] + at(p, 1) - origin[1],
            F.greatest(wrist[2] + at(p, 2) - origin[2], lit(0.01)),
        ),
    )
    return F.when(ok, moved)


def reprojection_confidence(points: Column, uv: Column, k, width: Column, height: Column, fallback: float) -> Column:
    """Logistic confidence of the mean pixel error over the diagonal; needs five usable joints."""
    k = G.elements(k, 9)
    at = lambda p, i: F.get(p, F.lit(i))

    def error(p, q):
        z = at(p, 2)
        du = at(p, 0) / z * k[0] + k[2] - at(q, 0)
        dv = at(p, 1) / z * k[4] + k[5] - at(q, 1)
        inside = (at(q, 0) > 0) & (at(q, 0) < width) & (at(q, 1) > 0) & (at(q, 1) < height)
        return F.when((z > lit(0.01)) & inside, F.sqrt(du * du + dv * dv))

    errors = F.array_compact(F.zip_with(points, uv, error))
    mean = F.aggregate(errors, lit(0), lambda a, e: a + e) / F.size(errors)
    share = mean / F.sqrt((width * width + height * height).cast("double"))
    value = 1 / (1 + F.exp(lit(200.0) * (share - lit(0.025))))
    return F.when(F.size(errors) < 5, lit(fallback)).otherwise(G.clamp(value, 0.05, 0.99))


def _palm_gate(points: Column, lo: float, hi: float):
    palm = distance(points, 5, 17)
    x = G.sub(point(points, 5), point(points, 2))
    forward = [(a + b) / 2 - w for a, b, w in zip(point(points, 5), point(points, 2), point(points, 0))]
    sine = G.norm(G.cross(x, forward)) / F.greatest(G.norm(x) * G.norm(forward), lit(1e-12))
    return (palm >= lit(lo)) & (palm <= lit(hi)) & (sine > lit(0.1))


def shape_valid(points: Column, valid: Column, palm=(0.035, 0.13), bone=(0.004, 0.12)) -> Column:
    """All joints valid, plausible palm and bones, axes not parallel."""
    bones = F.array(*[distance(points, a, b) for a, b in BONES])
    ok = (
        (F.size(points) == 21)
        & F.forall(valid, lambda v: v)
        & _palm_gate(points, *palm)
        & (F.array_min(bones) >= lit(bone[0]))
        & (F.array_max(bones) <= lit(bone[1]))
    )
    return F.coalesce(ok, F.lit(False))


def frame_valid(points: Column, valid: Column, min_ratio: float = 0.65, palm=(0.035, 0.13)) -> Column:
    """The joints of the hand frame are valid, and enough of the others."""
    core = F.lit(True)
    for j in FRAME_JOINTS:
        core = core & F.get(valid, F.lit(j))
    share = F.size(F.filter(valid, lambda v: v)) / F.lit(21.0)
    ok = (F.size(points) == 21) & (F.size(valid) == 21) & core & (share >= lit(min_ratio)) & _palm_gate(points, *palm)
    return F.coalesce(ok, F.lit(False))


def gates(full: bool, min_ratio: float = 0.65, palm=(0.035, 0.13), bone=(0.004, 0.12)):
    """:func:`shape_valid` (``full``) or :func:`frame_valid` of whole Arrow columns, where a row's formula would be too long to compile."""

    def judge(points: pa.Array, valid: pa.Array) -> pa.Array:
        out = np.zeros(len(points), bool)
        sizes = [pc.fill_null(pc.list_value_length(a), -1).to_numpy() for a in (points, valid)]
        rows = np.flatnonzero((sizes[0] == 21) & ((sizes[1] >= 0) if full else (sizes[1] == 21)))
        if not len(rows):
            return pa.array(out)
        place = points.take(pa.array(rows)).flatten()
        if place.null_count or (pc.list_value_length(place).to_numpy() != 3).any():
            place = pa.array([[*(p or []), None, None, None][:3] for p in place.to_pylist()], pa.list_(pa.float64()))
        flat = place.flatten()
        at = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 21, 3)
        none = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, 21, 3).any(2)
        sure = valid.take(pa.array(rows))
        yes = sure.flatten().fill_null(False).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(rows)), pc.list_value_length(sure).to_numpy())
        norm = lambda v: np.sqrt((v * v).sum(-1))
        with np.errstate(all="ignore"):
            width = norm(at[:, 5] - at[:, 17])
            x, forward = at[:, 5] - at[:, 2], (at[:, 5] + at[:, 2]) / 2 - at[:, 0]
            sine = norm(np.cross(x, forward)) / np.maximum(norm(x) * norm(forward), 1e-12)
            ok = (width >= palm[0]) & (width <= palm[1]) & (sine > 0.1)
            if full:
                a, b = np.array(BONES).T
                length, lost = norm(at[:, a] - at[:, b]), none[:, a] | none[:, b]
                ok &= (np.where(lost, np.inf, length).min(1) >= bone[0]) & (np.where(lost, -np.inf, length).max(1) <= bone[1])
                ok &= ~lost.all(1) & (np.bincount(of, ~yes, len(rows)) == 0)
            else:
                ok &= yes.reshape(-1, 21)[:, FRAME_JOINTS].all(1) & (np.bincount(of, yes, len(rows)) / 21.0 >= min_ratio)
        out[rows] = ok
        return pa.array(out)

    return judge


def gripper_segments(pose, closed: Column, width_closed: float, width_open: float, finger: float, root: float) -> Column:
    """Four line segments of a two-finger gripper in world coordinates."""
    half = F.when(closed, lit(width_closed / 2)).otherwise(lit(width_open / 2))
    local = {
        "root": [lit(0), lit(-(finger + root)), lit(0)],
        "left_base": [-half, lit(-finger), lit(0)],
        "right_base": [half, lit(-finger), lit(0)],
        "left_tip": [-half, lit(0), lit(0)],
        "right_tip": [half, lit(0), lit(0)],
    }
    world = {k: F.array(*G.apply_pose(pose, v)) for k, v in local.items()}
    pairs = (("root", "left_base"), ("root", "right_base"), ("left_base", "left_tip"), ("right_base", "right_tip"))
    return F.array(*[F.struct(world[a].alias("a"), world[b].alias("b")) for a, b in pairs])
