"""Rigid-body and camera geometry as column expressions.

A matrix is an ``ARRAY<DOUBLE>``, row-major: 9 numbers for 3x3, 16 for 4x4. Inside this module it
is a Python list of scalar columns, so products stay plain arithmetic inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Elements = list[Column]


def lit(x: float) -> Column:
    return F.lit(float(x))


def elements(value: Column | str | Sequence, n: int) -> Elements:
    """The first ``n`` elements of an array column, or the list itself."""
    if isinstance(value, (list, tuple)):
        return [v if isinstance(v, Column) else lit(v) for v in value]
    value = F.col(value) if isinstance(value, str) else value
    return [F.get(value, F.lit(i)) for i in range(n)]


def pack(values: Sequence[Column]) -> Column:
    """An array column; null when any element is null."""
    ok = values[0].isNotNull()
    for v in values[1:]:
        ok = ok & v.isNotNull()
    return F.when(ok, F.array(*values))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``; keeps long chains of formulas small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(values: Sequence[Column], body) -> Column:
    """:func:`let` for a list of scalar columns."""
    n = len(values)
    return let(F.array(*values), lambda a: body([F.get(a, F.lit(i)) for i in range(n)]))


def vec(value) -> Elements:
    return elements(value, 3)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def sub(a, b) -> Elements:
    return [x - y for x, y in zip(a, b)]


def add(a, b) -> Elements:
    return [x + y for x, y in zip(a, b)]


def scale(a, s) -> Elements:
    return [x * s for x in a]


def cross(a, b) -> Elements:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a, eps: float = 0.0) -> Elements:
    """Divide by the norm plus ``eps``."""
    n = norm(a) + lit(eps) if eps else norm(a)
    return [x / n for x in a]


def unit_or(a, fallback: Sequence[float], eps: float = 1e-8) -> Elements:
    """Unit vector, or a fixed one when the norm is not above ``eps``."""
    n = norm(a)
    return [F.when(n > lit(eps), x / n).otherwise(lit(f)) for x, f in zip(a, fallback)]


# --- 3x3 and 4x4 ---------------------------------------------------------------------------


def rotation(pose) -> Elements:
    """Rotation part of a 4x4 pose."""
    m = elements(pose, 16)
    return [m[4 * i + j] for i in range(3) for j in range(3)]


def translation(pose) -> Elements:
    """Translation part of a 4x4 pose."""
    m = elements(pose, 16)
    return [m[3], m[7], m[11]]


def from_parts(rot: Sequence[Column], trans: Sequence[Column]) -> Elements:
    r, t = list(rot), list(trans)
    return [*r[0:3], t[0], *r[3:6], t[1], *r[6:9], t[2], lit(0), lit(0), lit(0), lit(1)]


def matmul3(a, b) -> Elements:
    a, b = elements(a, 9), elements(b, 9)
    return [dot(a[3 * i : 3 * i + 3], b[j::3]) for i in range(3) for j in range(3)]


def transpose3(a) -> Elements:
    a = elements(a, 9)
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def apply3(a, v) -> Elements:
    a = elements(a, 9)
    return [dot(a[3 * i : 3 * i + 3], v) for i in range(3)]


def det3(a) -> Column:
    a = elements(a, 9)
    return dot(a[0:3], cross(a[3:6], a[6:9]))


def inverse3(a) -> Elements:
    """General 3x3 inverse by cofactors."""
    a = elements(a, 9)
    r0, r1, r2 = a[0:3], a[3:6], a[6:9]
    d = det3(a)
    columns = [cross(r1, r2), cross(r2, r0), cross(r0, r1)]
    return [columns[j][i] / d for i in range(3) for j in range(3)]


def compose(a, b) -> Elements:
    """4x4 product."""
    a, b = elements(a, 16), elements(b, 16)
    return [dot(a[4 * i : 4 * i + 4], b[j::4]) for i in range(4) for j in range(4)]


def inverse_rigid(pose) -> Elements:
    """Inverse of a rigid pose by transposition."""
    r, t = transpose3(rotation(pose)), translation(pose)
    return from_parts(r, [-x for x in apply3(r, t)])


def inverse_affine(pose) -> Elements:
    """Inverse of a pose with bottom row 0 0 0 1 and any invertible 3x3 block."""
    r, t = inverse3(rotation(pose)), translation(pose)
    return from_parts(r, [-x for x in apply3(r, t)])


def apply_pose(pose, point) -> Elements:
    m = elements(pose, 16)
    p = vec(point)
    return [dot(m[4 * i : 4 * i + 3], p) + m[4 * i + 3] for i in range(3)]


def transform_points(points: Column, pose) -> Column:
    """Apply a pose to an array of points."""
    m = elements(pose, 16)
    return F.transform(
        points, lambda p: F.array(*[dot(m[4 * i : 4 * i + 3], elements(p, 3)) + m[4 * i + 3] for i in range(3)])
    )


def se3_check(pose: Column) -> Column:
    """Shape, finiteness, orthonormality, determinant and bottom-row error of a pose."""
    shape = F.coalesce(F.size(pose) == 16, F.lit(False))
    finite = shape & F.forall(pose, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != lit(float("inf"))))
    m = elements(pose, 16)
    r = rotation(m)
    gram = matmul3(transpose3(r), r)
    eye = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    ortho = norm([g - lit(e) for g, e in zip(gram, eye)])
    bottom = norm([m[12], m[13], m[14], m[15] - lit(1)])
    return F.struct(
        shape.alias("valid_shape"),
        finite.alias("finite"),
        F.when(finite, ortho).alias("ortho_err"),
        F.when(finite, det3(r)).alias("det"),
        F.when(finite, bottom).alias("bottom_err"),
    )


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps null as null."""
    return F.when(x.isNotNull(), F.greatest(lit(lo), F.least(lit(hi), x)))


def rotation_angle(a, b, limit: float = 1.0) -> Column:
    """Geodesic angle between two rotations in degrees (F05). ``limit`` clamps the cosine."""
    trace = dot(elements(a, 9), elements(b, 9))
    return F.degrees(F.acos(clamp((trace - 1) / 2, -limit, limit)))


def encode_6d(rot) -> Elements:
    """First two columns of a rotation, flattened row by row."""
    r = elements(rot, 9)
    return [r[0], r[1], r[3], r[4], r[6], r[7]]


def _gram_schmidt(six, eps: float):
    x = elements(six, 6)
    a1, a2 = x[0::2], x[1::2]
    b1 = unit(a1, eps)
    d = dot(b1, a2)
    b2 = unit([q - d * p for p, q in zip(b1, a2)], eps)
    return b1, b2


def decode_6d(six, eps: float = 1e-8) -> Elements:
    """Rotation from six numbers by orthonormalising two columns."""
    b1, b2 = _gram_schmidt(six, eps)
    b3 = cross(b1, b2)
    return [c[i] for i in range(3) for c in (b1, b2, b3)]


def normalise_6d(six, eps: float = 1e-8) -> Elements:
    b1, b2 = _gram_schmidt(six, eps)
    return [c[i] for i in range(3) for c in (b1, b2)]


def normalise_position(p, mean, std) -> Elements:
    """Axis-wise normalisation; the small term is added on the way in only."""
    return [(a - m) / (s + lit(1e-8)) for a, m, s in zip(vec(p), vec(mean), vec(std))]


def unnormalise_position(p, mean, std) -> Elements:
    return [a * s + m for a, m, s in zip(vec(p), vec(mean), vec(std))]


def quaternion_to_rotation(q) -> Elements:
    """Rotation of an xyzw quaternion; identity when its norm is zero."""
    q = elements(q, 4)
    n = norm(q)
    x, y, z, w = [F.when(n >= lit(1e-12), c / n).otherwise(lit(d)) for c, d in zip(q, (0, 0, 0, 1))]
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def pose7_to_pose(p) -> Elements:
    """4x4 pose of ``x y z qx qy qz qw``."""
    p = elements(p, 7)
    return from_parts(quaternion_to_rotation(p[3:7]), p[0:3])


def log_map(rot) -> Column:
    """Rotation vector of a rotation, as an array."""
    rot = rot if isinstance(rot, Column) else F.col(rot) if isinstance(rot, str) else F.array(*rot)

    def vector(q):
        r, cosine, sine = elements(q["r"], 9), q["c"], q["s"]
        axis = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
        angle = F.atan2(sine, cosine)
        # Close to half a turn the antisymmetric part vanishes: take the axis from the diagonal.
        size = [F.sqrt(F.greatest(lit(0), (r[i] - cosine) / (1 - cosine))) for i in (0, 4, 8)]
        no_x = size[0] < lit(1e-9)
        flip = [
            lit(1),
            F.when(~no_x & (r[1] + r[3] < 0), lit(-1)).otherwise(lit(1)),
            F.when(F.when(no_x, r[5] + r[7]).otherwise(r[2] + r[6]) < 0, lit(-1)).otherwise(lit(1)),
        ]
        return F.array(
            *[
                F.when(sine > lit(1e-7), a / (2 * sine) * angle).when(cosine > 0, a / 2).otherwise(s * f * angle)
                for a, s, f in zip(axis, size, flip)
            ]
        )

    def parts(m):
        r = elements(m, 9)
        sine = norm([r[7] - r[5], r[2] - r[6], r[3] - r[1]]) / 2
        cosine = clamp((r[0] + r[4] + r[8] - 1) / 2, -1, 1)
        return let(F.struct(m.alias("r"), cosine.alias("c"), sine.alias("s")), vector)

    return let(rot, parts)


def exp_map(vector: Column) -> Column:
    """Rotation of a rotation vector, as an array."""

    def build(q):
        x, y, z, a, b = (q[n] for n in "xyzab")
        return F.array(
            1 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
            b * x * y + a * z, 1 - b * (x * x + z * z), b * y * z - a * x,
            b * x * z - a * y, b * y * z + a * x, 1 - b * (x * x + y * y),
        )

    def factors(q):
        angle = q["n"]
        small = angle < lit(1e-12)
        a = F.when(small, lit(1)).otherwise(F.sin(angle) / angle)
        b = F.when(small, lit(0.5)).otherwise((1 - F.cos(angle)) / (angle * angle))
        x, y, z = (F.get(q["v"], F.lit(i)) for i in range(3))
        return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z"), a.alias("a"), b.alias("b")), build)

    return let(vector, lambda v: let(F.struct(v.alias("v"), norm(vec(v)).alias("n")), factors))


def slerp(r0, r1, t: Column) -> Column:
    """Rotation at fraction ``t`` of the way from one rotation to another, as an array."""
    r0, r1 = elements(r0, 9), elements(r1, 9)
    turn = log_map(matmul3(transpose3(r0), r1))
    part = exp_map(F.transform(turn, lambda c: c * t))
    return let(part, lambda m: F.array(*matmul3(r0, m)))


def interpolate_pose(a, b, t: Column) -> Column:
    """Linear position and spherical rotation between two poses, as an array."""
    pos = [p + (q - p) * t for p, q in zip(translation(a), translation(b))]
    return let(slerp(rotation(a), rotation(b), t), lambda m: F.array(*from_parts(elements(m, 9), pos)))


def roll_pitch_yaw(rot) -> Elements:
    """Z-Y-X Euler angles in radians with the gimbal branch."""
    r = elements(rot, 9)
    sy = F.sqrt(r[0] * r[0] + r[3] * r[3])
    free = sy > lit(1e-6)
    return [
        F.when(free, F.atan2(r[7], r[8])).otherwise(F.atan2(-r[5], r[4])),
        F.atan2(-r[6], sy),
        F.when(free, F.atan2(r[3], r[0])).otherwise(lit(0)),
    ]


def euler_to_rotation(rx: Column, ry: Column, rz: Column, order: str = "xyz") -> Elements:
    """Rotation from Euler angles; ``order`` names the axes in the order they are applied."""
    one, zero = lit(1), lit(0)
    axes = {
        "x": [one, zero, zero, zero, F.cos(rx), -F.sin(rx), zero, F.sin(rx), F.cos(rx)],
        "y": [F.cos(ry), zero, F.sin(ry), zero, one, zero, -F.sin(ry), zero, F.cos(ry)],
        "z": [F.cos(rz), -F.sin(rz), zero, F.sin(rz), F.cos(rz), zero, zero, zero, one],
    }
    if sorted(order) != ["x", "y", "z"]:
        raise ValueError(f"axis order must use x, y and z once: {order}")
    first, second, third = order
    return matmul3(axes[third], matmul3(axes[second], axes[first]))


def rotation_z(angle: Column) -> Elements:
    c, s, o, z = F.cos(angle), F.sin(angle), lit(1), lit(0)
    return [c, -s, z, s, c, z, z, z, o]


def mirror_pose(pose) -> Elements:
    """Reflect a pose across the camera's vertical plane."""
    m = elements(pose, 16)
    sign = [-1 if (i // 4 == 0) != (i % 4 == 0) else 1 for i in range(16)]
    return [-x if s < 0 else x for x, s in zip(m, sign)]


def mirror_intrinsics(k, width: Column) -> Elements:
    k = elements(k, 9)
    return [k[0], k[1], width - k[2], *k[3:]]


# --- cameras -------------------------------------------------------------------------------

PROJECTION_MODES = ("front", "in_image", "unit", "clamped")


def project(point, k, mode: str = "front", width: Column | None = None, height: Column | None = None) -> Column:
    """Pinhole projection to ``struct(u, v, valid)`` with one of four guards.

    * ``front``: valid when z > 1e-6, otherwise pixel (0, 0).
    * ``in_image``: valid when z > 1e-3 and the pixel is inside the image, otherwise (0, 0);
      the divisor is z + 1e-6.
    * ``unit``: pixel divided by the image size and clipped to 0..1; (0.5, 0.5) when z < 1e-4.
    * ``clamped``: z is raised to at least 1e-6; always valid.
    """
    p, k = vec(point), elements(k, 9)
    hu, hv, hw = apply3(k, p)
    z = p[2]
    if mode == "front":
        ok = F.coalesce(z > lit(1e-6), F.lit(False))
        u, v = F.when(ok, hu / hw).otherwise(lit(0)), F.when(ok, hv / hw).otherwise(lit(0))
    elif mode == "in_image":
        u, v = hu / (hw + lit(1e-6)), hv / (hw + lit(1e-6))
        ok = F.coalesce(
            (z > lit(1e-3)) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False)
        )
        u, v = F.when(ok, u).otherwise(lit(0)), F.when(ok, v).otherwise(lit(0))
    elif mode == "unit":
        ok = F.coalesce(z >= lit(1e-4), F.lit(False))
        u = F.when(ok, clamp((k[0] * p[0] / z + k[2]) / width, 0, 1)).otherwise(lit(0.5))
        v = F.when(ok, clamp((k[4] * p[1] / z + k[5]) / height, 0, 1)).otherwise(lit(0.5))
    elif mode == "clamped":
        depth = F.greatest(z, lit(1e-6))
        ok = z.isNotNull()
        u, v = k[0] * p[0] / depth + k[2], k[4] * p[1] / depth + k[5]
    else:
        raise ValueError(f"unknown projection mode: {mode}")
    return F.struct(u.alias("u"), v.alias("v"), ok.alias("valid"))


def unproject(u: Column, v: Column, depth: Column, k, width: Column, height: Column,
              near: float = 0.1, far: float = 3.0) -> Column:
    """Camera point of a pixel with depth; null outside the image or the depth range."""
    k = elements(k, 9)
    iu, iv = F.rint(u), F.rint(v)
    ok = (iu >= 0) & (iu < width) & (iv >= 0) & (iv < height) & (depth >= lit(near)) & (depth <= lit(far))
    return F.when(ok, F.array((u - k[2]) * depth / k[0], (v - k[5]) * depth / k[4], depth))


def skew3(t) -> Elements:
    z = lit(0)
    return [z, -t[2], t[1], t[2], z, -t[0], -t[1], t[0], z]


def stereo_pose_valid(pose) -> Column:
    """Proper rotation, homogeneous bottom row and a usable baseline."""
    m = elements(pose, 16)
    r, t = rotation(m), translation(m)
    gram = matmul3(transpose3(r), r)
    ok = F.abs(det3(r) - 1) <= lit(1e-5 + 1e-8)
    for i, (g, e) in enumerate(zip(gram, [1, 0, 0, 0, 1, 0, 0, 0, 1])):
        ok = ok & (F.abs(g - lit(e)) <= lit(1e-6 + 1e-5 * e))
    for value, e in zip(m[12:16], [0, 0, 0, 1]):
        ok = ok & (F.abs(value - lit(e)) <= lit(1e-8 + 1e-5 * e))
    return F.coalesce(ok & (norm(t) >= lit(1e-6)), F.lit(False))


def fundamental_matrix(k_left, k_right, left_to_right) -> Elements:
    """Fundamental matrix of two calibrated cameras."""
    r, t = rotation(left_to_right), translation(left_to_right)
    essential = matmul3(skew3(t), r)
    return matmul3(matmul3(transpose3(inverse3(k_right)), essential), inverse3(k_left))


def head_to_image(camera_to_head, raw_to_image) -> Elements:
    """4x4 from head to image camera: basis change after the inverse mounting pose."""
    basis = from_parts(elements(raw_to_image, 9), [lit(0)] * 3)
    return compose(basis, inverse_affine(camera_to_head))


def image_to_head(camera_to_head, raw_to_image) -> Elements:
    """4x4 from image camera to head coordinates."""
    basis = from_parts(transpose3(raw_to_image), [lit(0)] * 3)
    return compose(elements(camera_to_head, 16), basis)


def projection_matrix(k, camera_to_head, raw_to_image) -> Elements:
    """3x4 projection of head points to pixels, 12 numbers."""
    k = elements(k, 9)
    m = head_to_image(camera_to_head, raw_to_image)
    return [dot(k[3 * i : 3 * i + 3], [m[j], m[4 + j], m[8 + j]]) for i in range(3) for j in range(4)]


def epipolar_distance(left_uv, right_uv, fundamental) -> Column:
    """Mean of the two point-to-line distances (F16)."""
    f = elements(fundamental, 9)
    a = [*left_uv, lit(1)]
    b = [*right_uv, lit(1)]
    line_r, line_l = apply3(f, a), apply3(transpose3(f), b)
    residual = F.abs(dot(b, line_r))
    tiny = lit(1e-12)
    return residual / 2 * (
        1 / F.greatest(norm(line_r[:2]), tiny) + 1 / F.greatest(norm(line_l[:2]), tiny)
    )
