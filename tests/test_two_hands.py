"""Two-hand targets and evaluation against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import two_hands as H

MEAN, STD = np.array([0.1, 0.2, 0.3]), np.array([0.5, 0.6, 0.7])
ROW = "episode string, frame_idx int, cam0 array<double>, anchor array<double>, c2w array<double>, k array<double>, w int, h_px int, anchor_key string, is_finished double, hands map<string,struct<T:array<double>,grasp:double>>, objects map<string,struct<T:array<double>,is_dynamic:boolean>>"


def pose(pick):
    q, _ = np.linalg.qr(pick.normal(size=(3, 3)))
    out = np.eye(4)
    out[:3, :3] = q * np.sign(np.linalg.det(q))
    out[:3, 3] = pick.uniform(-0.3, 0.3, 3) + [0, 0, 1.0]
    return out


def made(seed, n=50):
    pick = np.random.default_rng(seed)
    flat = lambda m: m.ravel().tolist()
    rows = []
    for e in ("a", "b"):
        grasp = {"left": False, "right": False}
        for t in range(n):
            if pick.random() < 0.15:
                continue
            for s in grasp:
                grasp[s] ^= pick.random() < 0.3
            hands = {s: (flat(pose(pick)), float(g)) for s, g in grasp.items() if pick.random() > 0.25}
            objects = {o: (flat(pose(pick)), False) for o in ("cup", "lid") if pick.random() > 0.15}
            ref = None if pick.random() < 0.05 else flat(pose(pick))
            k = [500.0, 0.0, 300.0, 0.0, 510.0, 200.0, 0.0, 0.0, 1.0]
            rows.append((e, t, ref, flat(pose(pick)), flat(pose(pick)), k, 640, 480, "cup" if t % 9 else "lid", float(t > n - 4), hands, objects))
    return rows


def nine(m):
    a, b = m[:3, 0], m[:3, 1]
    x = a / (np.linalg.norm(a) + 1e-8)
    b = b - x @ b * x
    return np.concatenate([(m[:3, 3] - MEAN) / (STD + 1e-8), np.stack([x, b / (np.linalg.norm(b) + 1e-8)], 1).ravel()])


def plain(rows, horizon, stride, action, latch, frame):
    """The rules, one sample and one step at a time."""
    at = {(r[0], r[1]): r for r in rows}
    mat = lambda v, n=4: np.array(v).reshape(n, n)
    out = {}
    for r in rows:
        ref = r[2] if frame == "camera_frame" else r[3]
        ref = None if ref is None else np.linalg.inv(mat(ref))
        w2c, k = np.linalg.inv(mat(r[4])), mat(r[5], 3)

        def uv(m):
            p = w2c[:3, :3] @ m[:3, 3] + w2c[:3, 3]
            return [0.5, 0.5] if p[2] < 1e-4 else [min(max(v, 0.0), 1.0) for v in ((k[0, 0] * p[0] / p[2] + k[0, 2]) / 640, (k[1, 1] * p[1] / p[2] + k[1, 2]) / 480)]

        first, lock, steps = {}, None, []
        now = {"pos": np.zeros((2, 3)), "rot": np.zeros((2, 6)), "g": np.zeros(2), "obj": np.zeros(9), "uv": np.zeros((3, 2)), "done": 0.0}
        for j in range(1, horizon + 1):
            f = at.get((r[0], r[1] + j * stride))
            now = {c: np.copy(v) for c, v in now.items()}
            if f is not None:
                now["done"] = f[9]
                place = lambda name, m: (np.linalg.inv(first.setdefault(name, ref @ m)) if action == "delta" else np.eye(4)) @ ref @ m
                for h, s in enumerate(("left", "right")):
                    if s in f[10]:
                        m = mat(f[10][s][0])
                        if ref is not None:
                            v = nine(place(s, m))
                            now["pos"][h], now["rot"][h], now["g"][h] = v[:3], v[3:], f[10][s][1] > 0.5
                            now["uv"][h] = uv(m)
                now["obj"], now["uv"][2] = np.zeros(9), 0.0
                if r[8] in f[11] and ref is not None:
                    m = mat(f[11][r[8]][0])
                    if latch and f[10].get("right", (0, 0.0))[1] > 0.5:
                        hand = mat(f[10]["right"][0])
                        lock = np.linalg.inv(hand) @ m if lock is None else lock
                        m = hand @ lock
                    else:
                        lock = None
                    now["obj"], now["uv"][2] = nine(place("obj", m)), uv(m)
            steps.append(now)
        out[r[0], r[1]] = steps
    return out


@pytest.mark.parametrize(("action", "latch", "stride", "frame"), [("absolute", True, 1, "camera_frame"), ("delta", True, 2, "camera_frame"), ("delta", False, 1, "anchor_frame")])
def test_targets_equal_a_plain_loop(spark, small_chunks, action, latch, stride, frame):
    rows = made(7)
    df = spark.createDataFrame(rows, ROW).repartition(3).withColumn("actions", F.lit("clash"))
    got = H.two_hand_targets(df, 4, MEAN, STD, frame, action, stride=stride, latch=latch).collect()
    want = plain(rows, 4, stride, action, latch, frame)
    assert len(got) == len(rows)
    for r in got:
        for j, step in enumerate(want[r["episode"], r["frame_idx"]]):
            np.testing.assert_allclose(r["actions"][j], np.concatenate([step["pos"].ravel(), step["rot"].ravel(), step["g"]]), atol=1e-8)
            np.testing.assert_allclose(r["object"][j], step["obj"], atol=1e-8)
            np.testing.assert_allclose(r["trace"][j], step["uv"].ravel(), atol=1e-8)
            assert r["done"][j] == [step["done"]]


def test_one_hand_chosen_samples_and_no_frames(spark):
    df = spark.createDataFrame(made(8, 20), ROW)
    got = H.two_hand_targets(df, 3, MEAN, STD, sides=["right"], sample=F.col("frame_idx") % 5 == 0).collect()
    assert {r["frame_idx"] % 5 for r in got} == {0} and all(len(a) == 10 for r in got for a in r["actions"]) and all(len(t) == 4 for r in got for t in r["trace"])
    assert H.two_hand_targets(df.limit(0), 3, MEAN, STD).count() == 0
    with pytest.raises(ValueError):
        H.two_hand_targets(df, 3, MEAN, STD, sides=["left"])


def test_absent_hands_take_no_part(spark):
    hand = "struct<pos_pred:array<double>,pos_true:array<double>,o6d_pred:array<double>,o6d_true:array<double>,g_prob:double,g_true:double>"
    level, turned = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, -1.0, 1.0, 0.0, 0.0, 0.0]
    far, near = ([3.0, 0.0, 0.0], [0.0] * 3, turned, level, 0.9, 1.0), ([0.0, 4.0, 0.0], [0.0] * 3, level, level, 0.9, 0.0)
    rows = [(0, 1, far, near, 0.9, 1.0), (0, 1, far, None, 0.1, 1.0), (1, 1, None, near, 0.9, 1.0), (1, 1, None, None, 0.9, 0.0)]
    errors = H.side_errors(spark.createDataFrame(rows, f"batch_id int, k int, left {hand}, right {hand}, done_prob double, done_true double"))
    both = H.two_hands_by_step(errors).first()
    # Batch 0: (5 + 3) / 2 and (45 + 90) / 2; batch 1: 4 and 0 from the one sample with a hand.
    assert both["pos_err"] == pytest.approx(4.0) and both["rot_err"] == pytest.approx((67.5 + 0.0) / 2, abs=0.1)
    assert (both["tp"], both["fp"], both["fn"], both["done"], both["n"]) == (2, 2, 0, 2, 4)
    sides = {r["side"]: (r["pos_err"], r["n"]) for r in H.hands_by_step(errors).collect()}
    assert sides == {"left": (3.0, 2), "right": (4.0, 2)}
