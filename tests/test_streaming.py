"""Streaming state machines against the batch operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import audit, folds, latch
from framestride.plans import stream_queries
from framestride.plans.hand_queries import turning
from framestride.plans.object_queries import latch_inputs
from framestride.streaming import jobs


def run(spark, tmp_path, df, build, batches=2, order="frame_idx"):
    """Feed a frame as several files and collect what the query emits."""
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    jobs.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = df.orderBy(order).collect()
    schema = df.schema
    for part in np.array_split(np.arange(len(rows)), batches):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        build(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", check)
        .outputMode("append").trigger(availableNow=True).start()
    )
    done = query.awaitTermination(60)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if not done:
        query.stop()
        raise TimeoutError("stream did not finish")
    return spark.read.parquet(sink)


try:
    import google.protobuf  # noqa: F401

    STATEFUL = True
except ImportError:
    STATEFUL = False
stateful = pytest.mark.skipif(not STATEFUL, reason="transformWithStateInPandas needs protobuf")


@stateful
def test_streaming_hysteresis_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("a", s, i, None if rng.random() < 0.2 else float(rng.uniform(0.6, 1.4))) for s in ("left", "right") for i in range(30)]
    df = spark.createDataFrame(rows, "episode string, side string, frame_idx long, ratio double")
    got = run(spark, tmp_path, df, jobs.grasp_hysteresis).toPandas()
    want = folds.hysteresis(df.withColumn("pos", F.col("frame_idx")), "ratio").toPandas()
    key = ["episode", "side", "frame_idx"]
    both = got.merge(want, on=key, suffixes=("", "_w"))
    assert len(got) == len(want) == len(both) and (both.grasp_state == both.grasp_state_w).all()


def _poses(angles, xs):
    c, s = np.cos(np.radians(angles)), np.sin(np.radians(angles))
    return [[a, -b, 0.0, x, b, a, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0] for a, b, x in zip(c.tolist(), s.tolist(), xs)]


@stateful
def test_streaming_motion_audit(spark, tmp_path):
    times = [float(i) if i != 4 else 3.0 for i in range(9)]
    poses = _poses(np.where(np.arange(9) >= 7, 100.0, 0.0), [float(i >= 6) for i in range(9)])
    rows = [("a", e, e.split("_")[0], i, times[i], poses[i]) for e in ("camera", "hand_left") for i in range(9)]
    df = spark.createDataFrame(rows, "episode string, entity string, kind string, pos long, ts_s double, T array<double>")
    got = {(r.frame, r.metric, r.severity) for r in run(spark, tmp_path, df, lambda s: jobs.motion_audit(s, 1.0), batches=3, order="pos").collect()}
    clock = {("4", "dt", "error"), ("5", "dt", "warning")}
    assert got == clock | {(f, f"{e}_{m}", "warning") for e in ("camera", "hand_left") for f, m in (("6", "translation_step"), ("7", "rotation_step_deg"))}


@stateful
def test_streaming_motion_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    poses = _poses(rng.uniform(-90, 90, 40), rng.uniform(0, 1, 40).tolist())
    rows = [("a", e, e, i, i / 10, None if rng.random() < 0.1 else poses[i]) for e in ("camera", "hand") for i in range(40) if rng.random() > 0.1]
    df = spark.createDataFrame(rows, "episode string, entity string, kind string, pos long, ts_s double, T array<double>")
    columns = ["entity", "pos", "translation_step", "speed", "rotation_step_deg"]
    key = lambda r: (r.entity, r.pos)
    got = sorted(run(spark, tmp_path, df, jobs.entity_motion, batches=5, order="pos").select(columns).collect(), key=key)
    assert got == sorted(audit.entity_motion(df).select(columns).collect(), key=key) and len(got) == len(rows)


@stateful
def test_streaming_commands_equal_batch(spark, tmp_path):
    pose = lambda x: np.array([1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], float).tolist()
    df = spark.createDataFrame([("a", "r", i, pose(float(i % 5))) for i in range(12)], "episode string, side string, frame_idx long, T array<double>")
    got = run(spark, tmp_path, df, jobs.command_smoothing).orderBy("frame_idx").toPandas()
    want = folds.smooth_commands(df.withColumn("pos", F.col("frame_idx")), "T").orderBy("pos").toPandas()
    np.testing.assert_allclose(np.stack(got.command), np.stack(want.command))


def test_streaming_latch_step_state(spark, tmp_path):
    if not STATEFUL:
        pytest.skip("transformWithStateInPandas needs protobuf")
    eye = np.eye(4).ravel().tolist()
    at = lambda x: (np.eye(4) + np.array([[0, 0, 0, x]] + [[0] * 4] * 3)).ravel().tolist()
    rows = [("a", -1, None, None, eye, "obj2", False)]
    rows += [("a", t, "right", t >= 2, at(0.01 * t), None, None) for t in range(6)]
    df = spark.createDataFrame(rows, "episode string, frame_idx long, side string, grasp boolean, T array<double>, obj string, is_anchor boolean")
    got = run(spark, tmp_path, df, jobs.latch).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [2, 3, 4, 5]
    np.testing.assert_allclose([r.T[3] for r in got], [0, 0.01, 0.02, 0.03], atol=1e-12)


VIDEO, TRACK = "episode string, frame_idx long, ts timestamp", "episode string, tracking_index long, tracking_ts timestamp"


def _at(us):
    return datetime(2024, 1, 1) + timedelta(microseconds=int(us))


def _synced(spark, tmp_path, video, track, tolerance_us, delay, batches=5):
    """Play two streams in slices of time, with closing rows at the end."""
    jobs.configure(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    streams = []
    for name, rows, schema, columns in (("v", video, VIDEO, ("frame_idx", "ts")), ("t", track, TRACK, ("tracking_index", "tracking_ts"))):
        for part in np.array_split(np.arange(len(rows)), batches):
            spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        jobs.closing(spark.createDataFrame(rows, schema), *columns, "1 day").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = jobs.synchronise(*streams, tolerance_us, delay)
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    query = writer.outputMode("append").trigger(availableNow=True).start()
    done = query.awaitTermination(90)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert done and len(query.recentProgress) > batches
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("episode", "frame_idx").collect()]


def _nearest(video, track, tolerance_us):
    """The plain rule: the closest row, the earlier one on a tie, nothing outside the tolerance."""
    out = []
    for e, f, ts in video:
        near = [(abs(t - ts), t, i) for o, i, t in track if o == e]
        gap, t, i = min(near, default=(None, None, None))
        micros = None if gap is None else (t - ts) // timedelta(microseconds=1)
        ok = gap is not None and abs(micros) <= tolerance_us
        out.append((e, f, i if ok else None, micros if ok else None, ok))
    return sorted(out)


@stateful
def test_streaming_sync_equals_the_plain_rule(spark, tmp_path):
    rng = np.random.default_rng(2)
    video = [(e, i, _at(33_333 * i + rng.integers(0, 3000))) for i in range(60) for e in ("a", "b", "none")]
    track = [(e, i, _at(14_000 * i + rng.integers(-2000, 2000))) for i in range(150) for e in ("a", "b") if e == "a" or not 40 < i < 80]
    got = _synced(spark, tmp_path, video, track, 50_000, "200 milliseconds")
    assert got == _nearest(video, track, 50_000) and any(not r[-1] for r in got if r[0] == "b")


@stateful
def test_streaming_sync_ties_and_exact_limits(spark, tmp_path):
    video = [("a", 0, _at(1_000_000)), ("a", 1, _at(2_000_000)), ("a", 2, _at(3_000_000)), ("a", 3, _at(4_000_001))]
    track = [("a", 10, _at(950_000)), ("a", 11, _at(1_050_000)), ("a", 12, _at(2_050_000)), ("a", 13, _at(3_050_001)), ("a", 14, _at(3_950_001))]
    got = _synced(spark, tmp_path, video, track, 50_000, "100 milliseconds", batches=2)
    assert got == [("a", 0, 10, -50_000, True), ("a", 1, 12, 50_000, True), ("a", 2, None, None, False), ("a", 3, 14, -50_000, True)]


def test_streaming_distinct(spark, tmp_path):
    video = spark.createDataFrame([("a", i, _at(100_000 * i)) for i in range(20)], VIDEO)
    assert run(spark, tmp_path, video.unionByName(video.limit(5)), jobs.distinct_frames).count() == 20


@stateful
def test_played_streams_carry_state_over_batches(spark):
    """The registered latch and command streams, in several micro-batches, equal the batch operators."""
    sf = "/root/testdata/sf0.001"
    hands, objects, anchors = latch_inputs(spark, sf)
    want = {(r.episode, r.pos, r.obj): r.T for r in latch.propagate(hands, objects, anchors).where("is_dynamic").collect()}
    got = stream_queries.streaming_latch(spark, sf).collect()
    assert got and all(np.allclose(r.T, want[r.episode, r.frame_idx, r.obj], atol=1e-5) for r in got)
    held = {(r.episode, r.frame_idx) for r in got}
    assert len(held) > 0.5 * len({k[:2] for k in want})
    want = {(r.episode, r.pos): r.command for r in folds.smooth_commands(turning(spark, sf), "T").where("command is not null").collect()}
    got = stream_queries.streaming_command_smoothing(spark, sf).collect()
    assert len(got) == len(want) and all(np.allclose(r.command, want[r.episode, r.frame_idx], atol=1e-5) for r in got)
