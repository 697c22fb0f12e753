"""Nulls, missing parts and open ranges: cases where rows must not vanish or shift."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import audit, features, hands, objects, skew
from framestride.plans import audit_plan
from framestride.sources import recordings


def pose(x: float) -> list[float]:
    return [float(v) for v in (1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]


def test_all_methods_stay(spark):
    ran = spark.range(150).select(F.lit("e").alias("episode"), F.concat(F.lit("m"), "id").alias("method"))
    frames = spark.createDataFrame([("e", 0), ("f", 0)], "episode string, frame_idx long")
    seen = spark.createDataFrame([("e", 0, "m7", "left", pose(1), 1.0)], "episode string, frame_idx long, method string, side string, T array<double>, grasp double")
    out = hands.hands_by_method(frames, seen, ran)
    assert out.count() == 300
    assert out.where("episode = 'e' and hands is not null").count() == 150
    assert out.where("episode = 'f' and hands is null").count() == 150


RECORDS = "episode string, frame_idx long, cam0 array<double>, anchor array<double>, hands map<string,struct<T:array<double>,grasp:double>>, objects map<string,struct<T:array<double>>>, anchor_key string"


def token_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, RECORDS).coalesce(1)
    out = features.add_tokens(df, (0.0, 0.0, 0.0), (1 - 1e-8,) * 3, **options).orderBy("frame_idx").collect()
    return [([t[1] if m else None for t, m in zip(r["tokens"], r["mask"])], sum(r["mask"]), r["dropped"]) for r in out]


def test_null_reference_does_not_shift_other_rows(spark):
    rows = [("e", k, None if k == 1 else pose(100.0 * k), None, {"right": (pose(0), 1.0)}, {"a": (pose(0.0),)} if k < 3 else {}, "a") for k in range(4)]
    got = token_rows(spark, rows)
    assert [g[1] for g in got] == [2, 0, 2, 1]
    assert [g[0][0] for g in got] == [0.0, None, -200.0, -300.0]


def test_null_object_pose_drops_that_object_only(spark):
    rows = [("e", 0, pose(0), None, {}, {"a": (pose(1),), "b": (None,), "c": (pose(3),)}, "b")]
    ((xs, n, dropped),) = token_rows(spark, rows)
    assert n == 2 and xs[1:3] == [1.0, 3.0] and dropped == 0


def test_entities_without_a_place_are_counted(spark):
    rows = [("e", 0, pose(0), None, {"right": (pose(0), 1.0)}, {f"o{k:02d}": (pose(k),) for k in range(12)}, "o00")]
    assert token_rows(spark, rows)[0][1:] == (8, 5)
    assert token_rows(spark, rows, size=13)[0][1:] == (13, 0)


def test_all_anchors_are_listed(spark):
    frames = spark.createDataFrame([("e", k, a, 1.0) for k, a in enumerate(["o2", "o1", "o3", None])], "episode string, frame_idx long, anchor_key string, is_finished double")
    entities = spark.createDataFrame([], "episode string, entity string, kind string, grasp double")
    row = audit.label_issues(frames, entities).where("metric = 'anchor_key'").first()
    assert row["value"] == "o1,o2,o3"


@pytest.mark.parametrize(("first", "last", "want"), [(2, None, [2, 3]), (None, 2, [1, 2]), (2, 2, [2]), (None, None, [1, 2, 3])])
def test_session_ranges(spark, first, last, want):
    names = spark.createDataFrame([(f"mps_demo_{k:03d}_vrs",) for k in (3, 1, 2)], "episode string")
    out = recordings.numbered_sessions(names, first, last, pattern=r"_(\d+)_vrs$")
    assert [r["session_index"] for r in out.collect()] == want


def test_recording_without_artefacts_starts_at_the_first_stage(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "episode string")
    done = spark.createDataFrame([("a", "s1"), ("c", "s1"), ("c", "s2")], "episode string, stage string")
    got = {r["episode"]: (r["completed"], r["start"]) for r in recordings.first_open_stage(names, done, ["s1", "s2"]).collect()}
    assert got == {"a": (["s1"], "s2"), "b": ([], "s1"), "c": (["s1", "s2"], None)}


def test_hot_and_plain_quantiles_agree_on_special_values(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1.5, 1.5, -3.0, 1e-300, 5.0, float("inf"), 2.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    at, names = [0.0, 0.1, 0.25, 0.5, 0.75, 0.8, 1.0], list("abcdefg")
    plain = skew._percentiles(df.withColumnRenamed("v", "_v"), ["k"], at, names).first()
    split = skew.exact_quantiles(df, ["k"], "v", at, names, max_rows=3).first()
    np.testing.assert_array_equal(np.array(plain[1:], float), np.array(split[1:], float))


def test_missing_anchor_is_an_error_of_the_other_objects(spark):
    rng = np.random.default_rng(1)
    rows = [(e, o, *map(float, rng.normal(size=3) * (3, 2, 1))) for e in ("named", "lost", "unnamed") for o in ("a", "b") for _ in range(20) if (e, o) != ("lost", "a")]
    points = spark.createDataFrame(rows, "episode string, obj string, x double, y double, z double")
    anchors = spark.createDataFrame([("named", "a"), ("lost", "a")], "episode string, anchor_key string")
    got = {(r["episode"], r["obj"]): (r["T"] is not None, r["error"]) for r in objects.object_frames(points, anchors).collect()}
    assert got == {
        ("named", "a"): (True, None), ("named", "b"): (True, None), ("lost", "b"): (False, "anchor without points"),
        ("unnamed", "a"): (False, "no anchor named"), ("unnamed", "b"): (False, "no anchor named"),
    }


def test_failed_adapters_and_points_behind_are_warnings(spark):
    frames = spark.createDataFrame([("e", k, pose(0), float(k)) for k in range(4)], "episode string, frame_idx long, c2w array<double>, z double")

    def adapter(row):
        if row["z"] == 1:
            raise ValueError("no model")
        return {"points": [] if row["z"] == 3 else [[0.0, 0.0, 1.0 if row["z"] == 0 else -1.0]]}

    points = objects.adapter_points(frames, adapter, ["z"]).join(frames.select("episode", "frame_idx", "c2w"), ["episode", "frame_idx"])
    got = {(r["frame"], r["metric"], r["severity"]) for r in objects.adapter_issues(points).collect()}
    assert got == {("1", "adapter", "warning"), ("2", "points_in_front", "warning")}


def test_audit_sees_images_masks_copies_and_missing_records(spark):
    eye = pose(0)
    rows = [
        (e, k, 1_000_000 * k, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], eye, {}, {}, "o", 1.0, 0.0 if k == 2 else 120.0, 0.0 if k == 1 else 0.5, f"{k:016x}")
        for e in ("a", "b")
        for k in range(4)
    ]
    schema = (
        "episode string, frame_idx long, ts long, k array<double>, c2w array<double>, hands map<string,struct<T:array<double>,grasp:double>>, "
        "objects map<string,struct<T:array<double>,is_dynamic:boolean>>, anchor_key string, is_finished double, brightness double, "
        "mask_arm_coverage double, dhash string"
    )
    training = spark.createDataFrame([tuple([float(x) for x in v] if i in (3, 4) else v for i, v in enumerate(r)) for r in rows], schema)
    listed = training.select("episode", "frame_idx").union(spark.createDataFrame([("b", 9)], "episode string, frame_idx long"))
    seen = audit_plan.audit(training, listed=listed)
    found = {r["metric"]: r["n"] for r in seen.issues.groupBy("metric").agg(F.count("*").alias("n")).collect()}
    assert found["brightness"] == 2 and found["mask_arm_coverage"] == 2 and found["mask_arm_coverage_jump"] == 4
    assert found["cross_episode_exact_dhash"] == 8 and found["dhash_prev_distance"] == 6 and found["record"] == 1
    clean = training.drop("mask_arm_coverage", "dhash").withColumn("brightness", F.lit(120.0))
    assert seen.score().first()["score"] < audit_plan.audit(clean).score().first()["score"]
