"""Readers and writers on small files."""

import numpy as np
from pyspark.sql import functions as F

from framestride.operators import dataset
from framestride.operators import sync as Y
from framestride.sources import records, sinks


def test_experiments_are_read_with_types(spark, tmp_path):
    path = tmp_path / "results.tsv"
    names = [f.name for f in records.read_experiments(spark, str(path.parent)).schema.fields]
    row = {n: "x" for n in names} | {n: "1.5" for n in names if n.endswith(("_m", "_deg", "_w", "seconds")) or n == "score"} | {"seed": "7", "epochs": "20", "score": ""}
    path.write_text("\t".join(names) + "\n" + "\t".join(row[n] for n in names) + "\n")
    got = records.read_experiments(spark, str(path)).collect()
    assert len(got) == 1 and (got[0]["seed"], got[0]["epochs"], got[0]["score"], got[0]["pos_err_w_m"]) == (7, 20, None, 1.5)


def test_undecodable_images_keep_their_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.png").write_bytes(bytes(range(6)))
    (tmp_path / "bad.png").write_bytes(b"xx")
    (tmp_path / "other.txt").write_bytes(b"x")
    got = records.read_images(spark, str(tmp_path), lambda b: np.frombuffer(b, np.uint8).reshape(2, 3)).collect()
    by = {r["path"].rsplit("/", 1)[-1]: r for r in got}
    assert set(by) == {"good.png", "bad.png"}
    assert by["good.png"]["luma"] == list(range(6)) and (by["good.png"]["w"], by["good.png"]["h"]) == (3, 2)
    assert not by["bad.png"]["image_read_ok"] and by["bad.png"]["luma"] is None


def test_training_table_has_one_file_per_chunk(spark, small_chunks, tmp_path):
    rows = spark.range(40).select(F.lit("t").alias("task"), F.when(F.col("id") < 30, "a").otherwise("b").alias("episode"), F.col("id").alias("frame_idx"))
    dataset.write_training(rows.repartition(7), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
    files = back.select("episode", F.input_file_name().alias("f"), "frame_idx").groupBy("episode", "f").agg(F.count("*").alias("n")).collect()
    assert max(r["n"] for r in files) <= 40 and len({r["f"] for r in files if r["episode"] == "a"}) <= 6


def matches(spark):
    video = spark.createDataFrame([("a", k, k * 100) for k in range(5)], "episode string, frame_idx long, ts long")
    track = spark.createDataFrame([("a", k, k * 100 + (90 if k == 3 else 3)) for k in range(5)], "episode string, tracking_index long, tracking_ts long")
    return Y.synchronise(video, track, 10, payload=["tracking_index"])


def test_sync_and_import_files(spark, tmp_path):
    sinks.write_sync(matches(spark), str(tmp_path / "sync"), per_ms=1.0)
    assert spark.read.json(str(tmp_path / "sync/sync_manifest")).count() == 5
    assert spark.read.json(str(tmp_path / "sync/sync_summary")).first()["status"] == "CHECK"
    sinks.write_import(matches(spark), str(tmp_path / "import"))
    assert spark.read.json(str(tmp_path / "import/manifest")).count() > 0


def test_repeat_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (1, 1.5), (2, 3.0)], "steps int, err double")
    sinks.write_repeats(rows, ["err"], str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/rows")).count() == 3
    assert spark.read.parquet(str(tmp_path / "r/summary")).count() == 2


def test_snapshot_files(spark, tmp_path):
    from framestride.operators.evaluation import experiment_results

    good = '{"pos_err_w_m": 0.5, "rot_err_w_deg": 20,\n "grasp_f1_w": 0.6}'
    files = {
        ("a", "eval_ep_001.json"): "{", ("a", "eval_ep_002.json"): good, ("b", "eval_ep_009.json"): good, ("b", "eval_ep_010.json"): "{\"pos",
        ("c", "eval_ep_001.json"): '{"pos_err_w_m": NaN, "rot_err_w_deg": 1, "grasp_f1_w": 1}', ("d", "other.json"): good,
    }
    for (run, name), text in files.items():
        (tmp_path / run / "eval_snapshots").mkdir(parents=True, exist_ok=True)
        (tmp_path / run / "eval_snapshots" / name).write_text(text)
    runs = spark.createDataFrame([(r,) for r in "abcd"], "experiment_id string")
    got = {r["experiment_id"]: (r["status"], r["score"]) for r in experiment_results(runs, records.read_snapshots(spark, str(tmp_path))).collect()}
    assert got["a"][0] == "SUCCESS" and abs(got["a"][1] - 0.64) < 1e-12
    assert {k: v[0] for k, v in got.items()} == {"a": "SUCCESS", "b": "EVAL_ERROR", "c": "NAN", "d": "EVAL_MISSING"}


def test_hand_files(spark, tmp_path):
    import json

    fields = {n: [1.0, 2.0] if t == "array<double>" else [[1.0, 2.0], [3.0, 4.0]] if "array" in t else {"k": 1.0} if "map" in t else 1 for n, t in records._HAND_TYPES.items()}
    assert len(fields) == 31
    for frame, text in {"00000": json.dumps({"idx": 0, "ts": 5, "hand_r": fields, "hand_l": None}, indent=1), "00001": "{"}.items():
        (tmp_path / "run" / "preprocess" / "all_data" / frame).mkdir(parents=True)
        (tmp_path / "run" / "preprocess" / "all_data" / frame / "hands.json").write_text(text)
    rows = records.hand_rows(records.read_records(spark, str(tmp_path), "hands", "hands.json")).collect()
    assert [(r["episode"], r["frame_idx"], r["side"]) for r in rows] == [("run", 0, "right")]
    assert all(rows[0][n] is not None for n in fields) and rows[0]["wrist_pose"] == [1.0, 2.0, 3.0, 4.0]
