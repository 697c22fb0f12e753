"""Geometry against NumPy, audit cases, stereo, readers and the query registry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framestride.config import audit_config, merge
from framestride.functions import geometry as G
from framestride.functions import hands as H
from framestride.functions import imaging
from framestride.operators import audit as A
from framestride.operators import features as X
from framestride.operators import folds
from framestride.operators import objects as O
from framestride.session import drop_stages, stage
from framestride.sources import records as J
from tests.conftest import SF


def poses(n=12, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        p = np.eye(4)
        p[:3, :3] = folds._rotation(rng.normal(0, 1, 3))
        p[:3, 3] = rng.normal(0, 1, 3)
        out.append(p)
    return out


def table(spark, a, b):
    rows = [(i, x.ravel().tolist(), y.ravel().tolist()) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "i int, a array<double>, b array<double>")


def values(df, column):
    return np.array([r[0] for r in df.orderBy("i").select(column).collect()], float)


def test_pose_algebra(spark):
    a, b = poses(seed=1), poses(seed=2)
    df = table(spark, a, b)
    np.testing.assert_allclose(values(df, F.array(*G.compose("a", "b"))), [(x @ y).ravel() for x, y in zip(a, b)], atol=1e-12)
    np.testing.assert_allclose(values(df, F.array(*G.inverse_rigid("a"))), [np.linalg.inv(x).ravel() for x in a], atol=1e-12)
    np.testing.assert_allclose(values(df, F.array(*G.inverse_affine("a"))), [np.linalg.inv(x).ravel() for x in a], atol=1e-12)
    angle = [np.degrees(np.linalg.norm(folds._rotation_vector(x[:3, :3].T @ y[:3, :3]))) for x, y in zip(a, b)]
    np.testing.assert_allclose(values(df, G.rotation_angle(G.rotation("a"), G.rotation("b"))), angle, atol=1e-6)
    w = values(df, G.log_map(F.array(*G.rotation("a"))))
    np.testing.assert_allclose(w, [folds._rotation_vector(x[:3, :3]) for x in a], atol=1e-9)
    half = values(df, G.interpolate_pose("a", "b", F.lit(0.3)))
    for m, x, y in zip(half.reshape(-1, 4, 4), a, b):
        turn = folds._rotation_vector(x[:3, :3].T @ y[:3, :3])
        np.testing.assert_allclose(m[:3, :3], x[:3, :3] @ folds._rotation(0.3 * turn), atol=1e-9)
        np.testing.assert_allclose(m[:3, 3], 0.7 * x[:3, 3] + 0.3 * y[:3, 3], atol=1e-12)


def test_half_turn_log_map(spark):
    flips = [np.diag([1.0, -1, -1]), np.diag([-1.0, 1, -1]), np.diag([-1.0, -1, 1]), np.eye(3)]
    df = spark.createDataFrame([(i, m.ravel().tolist()) for i, m in enumerate(flips)], "i int, r array<double>")
    np.testing.assert_allclose(np.abs(values(df, G.log_map("r"))), [[np.pi, 0, 0], [0, np.pi, 0], [0, 0, np.pi], [0, 0, 0]], atol=1e-9)


def test_six_numbers_of_the_identity(spark):
    df = spark.range(1).select(F.lit(0).alias("i"), F.array(*[F.lit(float(v)) for v in np.eye(3).ravel()]).alias("r"))
    assert values(df, F.array(*G.encode_6d("r")))[0].tolist() == [1, 0, 0, 1, 0, 0]
    assert values(df, F.array(*G.quaternion_to_rotation([F.lit(0.0)] * 4)))[0].tolist() == np.eye(3).ravel().tolist()


def test_pose9_udf_matches_the_expression(spark):
    df = table(spark, poses(seed=4), poses(seed=5))
    expr = [*G.normalise_position(G.translation("a"), [F.lit(0.1)] * 3, [F.lit(0.5)] * 3), *G.normalise_6d(G.encode_6d(G.rotation("a")))]
    np.testing.assert_allclose(values(df, X.pose9(F.col("a"), (0.1,) * 3, (0.5,) * 3)), values(df, F.array(*expr)), atol=1e-12)


def test_hamming_keeps_64_bits(spark):
    row = spark.range(1).select(A.hamming(F.lit("ffffffffffffffff"), F.lit("000000000000000f")).alias("d")).first()
    assert row.d == 60


def test_tracking_and_trajectory_do_not_score(spark):
    schema = "severity string, category string, episode string, frame string"
    frames = spark.range(10)
    issues = spark.createDataFrame([("warning", "trajectory", "a", str(i)) for i in range(10)], schema)
    assert A.quality_score(issues, frames).first().score == 100.0
    one = spark.createDataFrame([("error", "schema", "a", "0")], schema)
    assert A.quality_score(one, frames).first().score == pytest.approx(100 - 25 * 0.3)
    assert A.quality_score(issues.limit(0), frames.limit(0)).first().score == 100.0


def test_single_frame_episode_has_no_window_issue(spark):
    f = spark.createDataFrame([("a", 0, 5.0), ("b", 0, None)], "episode string, frame_idx int, ts double")
    out = A.temporal_metrics(f)
    assert out.count() == 2 and A.temporal_issues(out).count() == 0


def test_temporal_plans_agree(small_chunks):
    from framestride.operators.bounds import measure

    rng = np.random.default_rng(1)
    ts = np.cumsum(rng.integers(1, 60, 40)) * 1_000_000
    rows = [("a", i, None if i % 9 == 4 else float(t)) for i, t in enumerate(ts)]
    f = small_chunks.createDataFrame(rows, "episode string, frame_idx int, ts double")
    split = A.temporal_metrics(f).orderBy("frame_idx").toPandas()
    small_chunks.conf.set("framestride.chunkRows", "1000")
    plain = A.temporal_metrics(measure(f, "episode")).orderBy("frame_idx").toPandas()
    for c in ("dt", "ts_s", "episode_median_dt"):
        np.testing.assert_allclose(split[c].astype(float), plain[c].astype(float), rtol=1e-12)


def test_config_merges_deeply():
    c = audit_config({"image": {"entropy_low": 1.0}})
    assert c["image"]["entropy_low"] == 1.0 and c["image"]["contrast_low"] == 18.0
    assert merge({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}


def test_image_statistics_against_numpy(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (6, 10))
    df = spark.createDataFrame([(0, img.ravel().tolist(), 10, 6)], "i int, luma array<int>, w int, h int")
    s = df.select(imaging.statistics(F.col("luma"), F.col("w"), F.col("h")).alias("s")).first().s
    p = np.pad(img, 1, mode="reflect").astype(float)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    share = np.unique(img, return_counts=True)[1] / img.size
    want = [img.mean(), img.std(), lap.var(), -(share * np.log2(share)).sum()]
    np.testing.assert_allclose([s.brightness, s.contrast, s.blur_laplacian, s.entropy], want)


def test_identical_hands_are_ambiguous(spark):
    uv = [[500.0 + 8 * j, 400.0 + 5 * (j % 4)] for j in range(21)]
    rows = [("a", 0, e, i, "right", 0.9, uv) for e, i in (("left", 0), ("right", 0), ("right", 1))]
    hands = spark.createDataFrame(rows, "episode string, frame_idx int, eye string, hand_id int, side string, score double, uv array<array<double>>")
    k = F.array(*[F.lit(float(v)) for v in (700, 0, 540, 0, 700, 405, 0, 0, 1)])
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 0, -0.064, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    out = O.unique_matches(O.pair_points(O.candidate_pairs(hands), k, m)).collect()
    assert [r.rejection for r in out] == ["ambiguous_correspondence"] * 2


def test_pairs_of_points_equal_the_formulas(spark):
    """Points, errors and gates of whole pairs in one call, without a long formula per row, equal the column formulas."""
    rng = np.random.default_rng(4)
    hand = np.column_stack([rng.uniform(-0.05, 0.05, (21, 2)), rng.uniform(0.5, 0.7, 21)])
    image = lambda p: (700 * p[:, :2] / p[:, 2:] + [540, 405])
    left = image(hand)
    rights = [image(hand - [0.064, 0, 0]) + rng.normal(0, s, (21, 2)) for s in (0.0, 3.0, 40.0)]
    rows = [("a", 0, e, i, "right", 0.9, uv.tolist()) for e, uvs in (("left", [left]), ("right", rights)) for i, uv in enumerate(uvs)]
    rows.append(("a", 0, "right", 1, "right", 0.9, rights[2].tolist()))  # a detection number that comes twice
    hands = spark.createDataFrame(rows, "episode string, frame_idx int, eye string, hand_id int, side string, score double, uv array<array<double>>")
    k = F.array(*[F.lit(float(v)) for v in (700, 0, 540, 0, 700, 405, 0, 0, 1)])
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 0, -0.064, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    pairs = O.candidate_pairs(hands)
    out = O.pair_points(pairs, k, m)
    assert "triangulate" not in str(out._jdf.queryExecution().optimizedPlan()) and len(str(out._jdf.queryExecution().optimizedPlan())) < 20_000
    got = {r.right_id: r for r in out.collect()}
    each = pairs.select("right_id", F.posexplode(F.arrays_zip("left_uv", "right_uv")).alias("joint", "q"))
    at = lambda c, i: F.get(F.col(f"q.{c}_uv"), F.lit(i))
    each = each.select("right_id", "joint", at("left", 0).alias("lu"), at("left", 1).alias("lv"), at("right", 0).alias("ru"), at("right", 1).alias("rv"))
    want: dict = {}
    for r in sorted(O.triangulate_pairs(each, k, k, m).collect(), key=lambda r: (r.joint, r.x)):
        want.setdefault(r.right_id, []).append(r)
    assert set(got) == set(want) == {0, 1, 2} and len(got[1].points) == 42
    for i, rs in want.items():
        np.testing.assert_allclose(got[i].points, [(r.x, r.y, r.z) for r in rs], rtol=1e-6)
        assert got[i].valid == [r.valid for r in rs]
        wrist = max(r.epipolar_px for r in rs if r.joint == 0)
        assert abs(got[i].cost_px - np.median([r.epipolar_px for r in rs]) - wrist) < 1e-9
    assert all(got[0].valid) and not all(got[2].valid)


def test_hand_gates_of_columns_equal_the_formulas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = np.array([[0.02 * (j % 4) + 0.01 * (j // 4), 0.025 * (j // 4), 0.5] for j in range(21)])
        points = (base + rng.normal(0, 0.004, (21, 3))).tolist()
        valid: list = [True] * 21
        if i % 5 == 1:
            points[rng.integers(21)] = [None, 0.0, 0.5]
        if i % 5 == 2:
            valid[rng.integers(21)] = False
        if i % 5 == 3:
            valid[rng.integers(21)] = None
        rows.append((i, points[: 20 if i % 10 == 4 else 21], valid))
    rows += [(100, None, None), (101, [None] * 21, [True] * 21), (102, [], [])]
    df = spark.createDataFrame(rows, "i int, points array<array<double>>, valid array<boolean>")
    bone = {"palm": (0.01, 0.2), "bone": (0.004, 0.12)}
    sides = [(H.shape_valid, True, bone), (H.frame_valid, False, {"palm": (0.01, 0.2)})]
    for formula, full, limits in sides:
        both = df.select(formula(F.col("points"), F.col("valid"), **limits).alias("a"), F.arrow_udf(H.gates(full, **limits), "boolean")("points", "valid").alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] and 0 < sum(r.a for r in both) < len(both)


def test_stereo_pose_validity(spark):
    good = np.eye(4)
    good[0, 3] = -0.064
    bad = np.eye(4)
    df = table(spark, [good, bad], [good, bad])
    assert [r[0] for r in df.orderBy("i").select(G.stereo_pose_valid("a")).collect()] == [True, False]


def test_record_files(spark, tmp_path):
    base = tmp_path / "pour" / "rec_1" / "preprocess" / "all_data"
    for i, text in enumerate(['{"metadata": {"ts": 1.5, "anchor_key": "obj1"}}', '{"metadata": {"ts": ']):
        (base / f"{i:05d}").mkdir(parents=True)
        (base / f"{i:05d}" / "training.json").write_text(text)
    rec = J.read_records(spark, str(tmp_path), "training", "training.json").orderBy("frame_idx").collect()
    assert [(r.episode, r.frame_idx, r._corrupt_record is None) for r in rec] == [("rec_1", 0, True), ("rec_1", 1, False)]


def test_stage_round_trip(spark):
    df = stage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20
    drop_stages(spark)


def test_registry_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert entry.entry(spark).count() > 0
    for name in ("online_latch", "object_principal_frames", "latch_bindings"):
        assert queries[name](spark, SF).count() >= 0
