"""Window membership, the previous-axis rule, stereo on a turned rig and damped refinement against plain loops."""

import numpy as np
import pytest

from framestride.functions import hands as H
from framestride.operators import hands as hand_ops
from framestride.operators import objects as O
from framestride.operators import phases as P
from framestride.session import CHUNK_ROWS


@pytest.fixture(params=["whole", "split"])
def limit(request, spark):
    if request.param == "split":
        spark.conf.set(CHUNK_ROWS, "5")
    yield request.param
    spark.conf.unset(CHUNK_ROWS)


def test_frames_in_overlapping_and_turned_windows(spark, limit):
    frames = [("a", i) for i in range(40)] + [("a", 7), ("a", 7), ("b", 3), ("c", 1), (None, 2), ("a", None)]
    windows = [("a", 2, 9, 1), ("a", 4, 5, 2), ("a", 30, 22, 1), ("a", 33, 38, 0), ("b", 4, 9, 1), ("c", 0, 1, 2), ("d", 0, 9, 1), ("a", None, 9, 1)]
    f = spark.createDataFrame(frames, "episode string, frame_idx int").selectExpr("*", "1 as mode")
    w = spark.createDataFrame(windows, "episode string, start int, end int, mode int")
    got = sorted(map(tuple, P.frames_in_windows(f, w, "navigation").collect()))
    inside = lambda e, i: any(
        e == d and None not in (s, t) and min(s, t) <= i <= max(s, t) and m in (1, 2) for d, s, t, m in windows if i is not None
    )
    # A window with one end missing reaches from the known end to itself.
    want = sorted({(e, i) for e, i in frames if e and i is not None and (inside(e, i) or (e, i) == ("a", 9))})
    assert got == want
    assert P.frames_in_windows(f.limit(0), w, "navigation").count() == 0
    assert P.frames_in_windows(f, w.limit(0), "navigation").count() == 0


def _gripper(wrist, thumb, index):
    x = index - thumb
    if np.linalg.norm(x) < 1e-6:
        return None
    x = x / np.linalg.norm(x)
    arm = (thumb + index) / 2 - wrist
    y = arm - x * (arm @ x)
    if np.linalg.norm(arm) < 1e-4 or np.linalg.norm(y) < 1e-6:
        return None
    y = y / np.linalg.norm(y)
    return np.column_stack([x, y, np.cross(x, y)])


def test_previous_axis_rule_against_a_loop(spark, limit):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for episode, length in (("a", 60), ("b", 13), ("c", 1)):
        before = None
        for i in range(length):
            wrist, thumb, index = rng.normal(size=(3, 3))
            if episode == "b" and i < 3 or rng.random() < 0.25:
                index = thumb.copy() if i % 2 else 2 * wrist - thumb  # no x axis, no arm
            seen = bool(rng.random() > 0.2)
            fallback = np.linalg.qr(rng.normal(size=(3, 3)))[0]
            rows.append((episode, i, wrist.tolist(), thumb.tolist(), index.tolist(), fallback.ravel().tolist(), seen))
            if not seen:
                want[episode, i] = None
                continue
            own = _gripper(wrist, thumb, index)
            if own is None:
                own = fallback if before is None else before
            elif before is not None and before[:, 0] @ own[:, 0] < 0:
                own = own * [-1, -1, 1]
            want[episode, i] = before = own
    df = spark.createDataFrame(rows, "episode string, frame_idx int, w array<double>, t array<double>, i array<double>, back array<double>, seen boolean")
    df = df.withColumn("R", H.gripper_rotation_or_null(*[[df[c][j] for j in range(3)] for c in ("w", "t", "i")]))
    got = hand_ops.keep_previous_axes(df, "R", "back", df.seen, ["episode"]).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.episode, r.frame_idx]
        assert (r.R is None) == (w is None)
        if w is not None:
            np.testing.assert_allclose(np.reshape(r.R, (3, 3)), w, atol=1e-9)


def test_right_angles_start_the_sign_anew(spark, limit):
    axes = [(1, 0), (-1, 0), (0, 1), (0, -1), (0, 1)]
    rows = [("a", i, [float(c), float(-s), 0.0, float(s), float(c), 0.0, 0.0, 0.0, 1.0]) for i, (c, s) in enumerate(axes)]
    df = spark.createDataFrame(rows, "episode string, frame_idx int, R array<double>")
    out = hand_ops.keep_previous_axes(df, "R", keys=["episode"]).orderBy("frame_idx").collect()
    assert [(r.R[0], r.R[3]) for r in out] == [(1, 0), (1, 0), (0, 1), (0, 1), (0, 1)]
    assert hand_ops.keep_previous_axes(df.limit(0), "R", keys=["episode"]).count() == 0


def _huber(x, views):
    cost = 0.0
    for u, v, k, c2w in views:
        p = np.linalg.inv(c2w) @ [*x, 1]
        r = [1e3, 1e3] if p[2] < 1e-4 else [k[0] * p[0] / p[2] + k[2] - u, k[4] * p[1] / p[2] + k[5] - v]
        cost += sum(abs(e) - 0.5 if abs(e) > 1 else e * e / 2 for e in r)
    return cost


def test_refinement_reaches_the_least_cost(spark, limit):
    rng = np.random.default_rng(5)
    k = [600.0, 0.0, 320.0, 0.0, 610.0, 240.0, 0.0, 0.0, 1.0]
    views, points, by = [], [], {}
    for kpt in range(6):
        x = np.array([0.1 * kpt - 0.2, 0.05 * kpt, 2.0 + 0.2 * kpt])
        for f in range(4 + 3 * kpt):
            turn = np.eye(4)
            a = 0.05 * rng.normal()
            turn[:3, :3] = [[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]
            turn[:3, 3] = rng.normal(size=3) * 0.2
            p = np.linalg.inv(turn) @ [*x, 1]
            u, v = 600 * p[0] / p[2] + 320 + rng.normal(), 610 * p[1] / p[2] + 240 + rng.normal()
            if f % 4 == 3:
                u += 60  # an outlier
            if f == 2:
                turn = turn @ np.diag([-1.0, 1, -1, 1])  # looks away
            views.append(("e", "o", kpt, f, float(u), float(v), 1, k, turn.ravel().tolist()))
            by.setdefault(kpt, []).append((u, v, k, turn))
        points.append(("e", "o", kpt, *map(float, x + 0.03)))
    views += [("e", "o", 0, 99, None, 1.0, 1, k, np.eye(4).ravel().tolist()), ("e", "o", 0, 98, 5.0, 1.0, 0, k, None), ("e", None, 0, 1, 1.0, 1.0, 1, k, None)]
    points += [("e", "o", 50, 1.0, 2.0, 3.0), ("e", "o", 51, None, 2.0, 3.0)]
    v = spark.createDataFrame(views, "episode string, obj string, kpt int, frame_idx int, u double, v double, vis int, k array<double>, c2w array<double>")
    p = spark.createDataFrame(points, "episode string, obj string, kpt int, x double, y double, z double")
    got = {r.kpt: np.array([r.x, r.y, r.z]) for r in O.refine_points(v, p).collect()}
    assert len(got) == len(points) and got[50].tolist() == [1, 2, 3] and got[51].tolist() == [None, 2, 3]
    for kpt, rows in by.items():
        best = _huber(got[kpt], rows)
        for d in np.vstack([np.eye(3), -np.eye(3), rng.normal(size=(6, 3))]) * 1e-3:
            assert best <= _huber(got[kpt] + d, rows) + 1e-9
        assert best < _huber(np.array(points[kpt][3:]), rows)


def test_head_rig_rejects_by_every_gate(spark):
    left, right = np.eye(4), np.eye(4)
    left[:3, 3], right[:3, 3] = [-0.03, 0, 0], [0.03, 0, 0]
    a = 0.1
    right[:3, :3] = [[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]
    flip = np.diag([1.0, -1, -1])
    k = np.array([[700.0, 0, 540], [0, 700, 405], [0, 0, 1]])

    def pixel(e, x):
        q = k @ flip @ (np.linalg.inv(e) @ [*x, 1])[:3]
        return q[0] / q[2], q[1] / q[2]

    cases = {"good": (-0.5, 0, 0), "far": (-3.0, 0, 0), "near": (-0.05, 0, 0), "shifted": (-0.5, 0, 30)}
    rows = []
    for name, (z, du, dv) in cases.items():
        x = np.array([0.02, 0.03, z])
        (lu, lv), (ru, rv) = pixel(left, x), pixel(right, x)
        rows.append((name, float(lu), float(lv), float(ru + du), float(rv + dv), left.ravel().tolist(), right.ravel().tolist()))
    rows.append(("null", None, 1.0, 1.0, 1.0, left.ravel().tolist(), right.ravel().tolist()))
    df = spark.createDataFrame(rows, "name string, lu double, lv double, ru double, rv double, el array<double>, er array<double>")
    from pyspark.sql import functions as F

    K, D = F.array(*map(F.lit, k.ravel().tolist())), F.array(*map(F.lit, flip.ravel().tolist()))
    got = {r.name: r for r in O.triangulate_in_head(df.where("lu is not null"), K, K, F.col("el"), F.col("er"), D).collect()}
    assert {n: r.valid for n, r in got.items()} == {"good": True, "far": False, "near": False, "shifted": False}
    np.testing.assert_allclose([got["good"].x, got["good"].y, got["good"].z], [0.02, 0.03, -0.5], atol=1e-6)
    assert got["shifted"].epipolar_px > 6 and got["good"].epipolar_px < 1e-6
    wide = O.triangulate_in_head(df.where("name = 'good'"), K, K, F.col("el"), F.col("er"), D, min_ray_deg=20.0).first()
    assert not wide.valid and wide.ray_deg < 20
