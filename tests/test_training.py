"""The training table: one exchange, both plans, and a plain loop over the latch rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import training as T
from framestride.plans.training_queries import NEEDED, inputs

SF = "/root/testdata/sf0.001"
POSE = "struct<T:array<double>,grasp:double>"


def plain(frames, statics, anchor, disabled=()):
    """Object poses and flags of each frame by the rules, frame by frame. ``frames``: {side: (grasp, pose)}."""
    state = {s: {"on": False, "free": False, "obj": None, "lock": None} for s in ("left", "right")}
    poses, out = {k: v.copy() for k, v in statics.items()}, []
    for hands in frames:
        for side, (grasp, pose) in hands.items():
            s = state[side]
            s["free"] |= not grasp
            if grasp and not s["on"] and s["free"] and pose is not None:
                gaps = {o: np.linalg.norm(pose[:3, 3] - p[:3, 3]) for o, p in poses.items() if o != anchor}
                near = min(gaps, key=gaps.get, default=None)
                s["on"], s["obj"] = True, near if near is not None and gaps[near] < 0.2 else None
                s["lock"] = None if s["obj"] is None else np.linalg.inv(pose) @ poses[near]
            elif not grasp and s["on"]:
                s.update(on=False, obj=None)
            if s["on"] and s["obj"] and side not in disabled and pose is not None:
                poses[s["obj"]] = pose @ s["lock"]
        out.append({o: (p.copy(), any(s["obj"] == o for k, s in state.items() if k not in disabled)) for o, p in poses.items()})
    return out


def pose(x, y, angle=0.0):
    out = np.eye(4)
    out[:2, :2] = [[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]
    out[:2, 3] = x, y
    return out


def made(spark, seed, n=60, episodes=("a", "b", "c")):
    pick = np.random.default_rng(seed)
    records = {}
    for e in episodes:
        grasp = {"left": False, "right": False}
        frames = []
        for _ in range(n):
            hands = {}
            for side in grasp:
                grasp[side] ^= pick.random() < 0.2
                hands[side] = (grasp[side], None if pick.random() < 0.25 else pose(*pick.uniform(0, 0.4, 2), pick.uniform(-1, 1)))
            frames.append(hands)
        records[e] = frames
    flat = lambda m: None if m is None else m.ravel().tolist()
    rows = [(e, 2 * k, {s: (flat(p), float(g)) for s, (g, p) in hands.items()}) for e, frames in records.items() for k, hands in enumerate(frames)]
    keys = spark.createDataFrame([r[:2] for r in rows], "episode string, frame_idx long")
    tables = {
        "cameras": keys.selectExpr("*", "frame_idx * 10 as ts", "640 as w", "480 as h", "30D as fps", "array(1D) as k", "array(1D) as c2w"),
        "hands": spark.createDataFrame(rows, f"episode string, frame_idx long, hands map<string,{POSE}>"),
        "phases": keys.selectExpr("*", "if(frame_idx > 100, 4, 1) as mode"),
        "slam": keys.selectExpr("*", "0D as speed"),
        "hands_other": keys.where("frame_idx % 4 = 0").selectExpr("*", f"cast(map() as map<string,{POSE}>) as hands"),
    }
    statics = {"base": pose(0.2, 0.2), "cup": pose(0.1, 0.1), "lid": pose(0.3, 0.3)}
    objects = spark.createDataFrame([(e, o, flat(p)) for e in episodes for o, p in statics.items() if e != "c"], "episode string, obj string, T array<double>")
    anchors = spark.createDataFrame([(e, "base") for e in episodes], "episode string, anchor_key string")
    return tables, objects, anchors, records, statics


@pytest.mark.parametrize("disabled", [(), ("left",), ("left", "right")])
@pytest.mark.parametrize("rows", [None, 10])
def test_training_table_equals_a_plain_loop(spark, small_chunks, disabled, rows):
    tables, objects, anchors, records, statics = made(spark, 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.training_table(tables, objects, anchors, disabled, rows or 1000).orderBy("episode", "frame_idx").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, records.values()))
    for e, frames in records.items():
        want = plain(frames, statics if e != "c" else {}, "base", disabled)
        for k, r in enumerate(r for r in got if r["episode"] == e):
            assert (r["frame_idx"], r["ts"], r["anchor_key"], r["is_finished"]) == (2 * k, 20 * k, "base", float(2 * k > 100))
            assert set(r["hands"]) == {s for s, (_, p) in frames[k].items() if p is not None}
            assert r["hands_other"] == ({} if k % 2 == 0 else None)
            assert set(r["objects"]) == set(want[k])
            for o, (p, dynamic) in want[k].items():
                assert r["objects"][o]["is_dynamic"] == dynamic
                np.testing.assert_allclose(r["objects"][o]["T"], p.ravel(), atol=1e-9)


def test_rows_are_moved_once(spark):
    tables, objects, anchors = inputs(spark, SF)
    # The records are read back so that only the operator's own plan is counted.
    tables = {k: spark.createDataFrame(t.collect(), t.schema) for k, t in tables.items()}
    objects, anchors = (spark.createDataFrame(t.collect(), t.schema) for t in (objects, anchors))
    out = T.training_table(tables, objects, anchors)
    plan = out._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY_COL" in line]
    assert len(wide) == 1 and plan.count("MapInArrow") == 1


def test_frames_without_a_record_are_left_out(spark):
    tables, objects, anchors, _, _ = made(spark, 5, 20, ("a",))
    tables["slam"] = tables["slam"].where("frame_idx <> 6")
    tables["phases"] = tables["phases"].where("frame_idx <> 8")
    assert sorted(r["frame_idx"] for r in T.training_table(tables, objects, anchors).collect()) == [2 * k for k in range(20) if k not in (3, 4)]
    seen = T.presence({"listed": tables["cameras"].select("episode", "frame_idx"), **{t: tables[t] for t in NEEDED}})
    got = T.counters(seen, NEEDED).collect()
    assert [(r["total"], r["valid"], r["discarded_missing_file"]) for r in got] == [(20, 18, 2)]


def test_no_frames(spark):
    tables, objects, anchors, _, _ = made(spark, 5, 2, ("a",))
    nothing = {k: t.limit(0) for k, t in tables.items()}
    assert T.training_table(nothing, objects, anchors).count() == 0
    assert T.training_table(tables, objects.limit(0), anchors.limit(0)).select(F.size("objects")).distinct().collect() == [(0,)]


def test_robot_sessions_split_and_edge_records(spark, small_chunks):
    import json

    from framestride.operators import training as T
    from framestride.sources import records as J

    eye = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]

    def pose(x):
        return [[1.0, 0, 0, x], *eye[1:]]

    lines = []
    for i in range(12):
        closed = 0.1 if 3 <= i < 8 else 0.9
        lines.append(("two", i, json.dumps({"ts": i, "arms": {s: {"T_ee_in_cam": pose(0.01 * i), "gripper_q": closed, "joints": [i, i + 1]} for s in ("left", "right")}})))
        lines.append(("one", i, json.dumps({"ts": i, "T_ee_in_cam": pose(0.01 * i), "gripper_q": closed, "joints": [i]})))
        lines.append(("left only", i, json.dumps({"ts": i, "arms": {"left": {"T_ee_in_cam": pose(0.0), "gripper_q": 0.1}}})))
        lines.append(("no meta", i, json.dumps({"ts": i, "T_ee_in_cam": pose(0.0), "gripper_q": closed})))
    lines += [("one", 12, "{broken"), ("one", 13, json.dumps({"ts": 13})), ("two", 12, None)]
    text = spark.createDataFrame(lines, "episode string, frame_idx long, value string")
    states = J.parse_records(text, "robot")
    images = text.select("episode", "frame_idx").union(text.select("episode", "frame_idx")).where("not (episode = 'two' and frame_idx = 1)")
    facts = [("two", '{"dual_arm": true, "cameras": {"wrist": {"w": 10}}}'), ("one", '{"w": 99}'), ("left only", "{}"), ("bad", "{oops")]
    meta = J.session_meta(J.parse_records(spark.createDataFrame(facts, "episode string, value string"), "session"))
    known = {r.episode: r for r in meta.collect()}
    assert set(known) == {"two", "one", "left only"}
    assert known["two"].cameras["wrist"].w == 10 and known["two"].cameras["wrist"].h == 480 and known["two"].cameras["cam0"].w == 640
    assert (known["one"].w, known["one"].h, known["one"].fps, known["one"].dual_arm) == (99, 480, 30.0, False)
    objects = spark.createDataFrame([(e, o, [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for e in ("two", "one", "left only") for o, x in (("base", 0.03), ("cup", 0.1))], "episode string, obj string, T array<double>")
    anchors = spark.createDataFrame([(e, "base") for e in ("two", "one", "left only")], "episode string, anchor_key string")

    def rows():
        out = T.robot_table(states, images, meta, objects, anchors, tail=2).collect()
        return {(r.episode, r.frame_idx): r for r in out}, out

    split, listed = rows()
    spark.conf.set("framestride.chunkRows", "1000")
    whole, _ = rows()
    assert split == whole and len(listed) == len(split)
    assert {e for e, _ in split} == {"two", "one", "left only"}
    assert ("two", 1) not in split and ("one", 12) not in split and split["one", 13].hands == {} and split["left only", 5].hands == {}
    assert set(split["two", 4].hands) == {"left", "right"} and split["one", 4].hands["right"].joints == [4.0]
    assert split["one", 4].hands["right"].grasp == 1.0 and split["one", 2].hands["right"].grasp == 0.0
    cup = {i: split["one", i].objects["cup"] for i in range(12)}
    assert [i for i in cup if cup[i].is_dynamic] == [3, 4, 5, 6, 7]
    assert abs(cup[7].T[3] - (0.1 + 0.04)) < 1e-12 and abs(cup[11].T[3] - 0.14) < 1e-12
    assert not any(r.objects["base"].is_dynamic or r.objects["cup"].is_dynamic for (e, _), r in split.items() if e == "left only")
    assert [split["left only", i].is_finished for i in (9, 10, 11)] == [0.0, 1.0, 1.0]
