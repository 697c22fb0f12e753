"""Many short series in one call give what one series at a time gives, and partitions follow the rows."""

import numpy as np
from pyspark.sql import functions as F

from framestride.operators import bounds, folds
from framestride.plans.surrogate import frames
from framestride.streaming import jobs
from tests.test_folds import ema_loop
from tests.test_streaming import run


def test_bundles_hold_whole_series(spark, monkeypatch):
    monkeypatch.setattr(folds, "BUNDLE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rng = np.random.default_rng(1)
    values = {e: [None if rng.random() < 0.2 else float(rng.normal()) for _ in range(int(rng.integers(1, 90)))] for e in [*range(40), None]}
    rows = [(e, "right", i, v) for e, series in values.items() for i, v in enumerate(series)]
    df = bounds.measure(spark.createDataFrame(rows, "episode long, side string, pos long, d double").repartition(3), "episode")
    calls = spark.sparkContext.accumulator(0)
    counted = folds.bundled(df, ["episode", "side"], ["pos"], lambda t, s: calls.add(1) or t, df.schema)
    assert counted.count() == len(rows) and 1 < calls.value < len(values)
    got = {(r.episode, r.pos): r.d for r in folds.symmetric_ema(df, ["d"], 0.55).collect()}
    for e, series in values.items():
        want = ema_loop(np.array(series, float), 0.55)
        np.testing.assert_allclose(np.array([got[e, i] for i in range(len(series))], float), want, atol=1e-9)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(bounds, "PART_ROWS", 100)
    rows = frames(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= rows.count() / 100


def test_stream_states_of_a_bucket(spark, tmp_path, monkeypatch):
    """Series that share one bucket keep their own states over micro-batches; a null recording is a series too."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    pose = lambda x: np.array([1, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], float).tolist()
    rows = [(e, "r", i, pose(float((i * (k + 1)) % 5))) for k, e in enumerate([1, 2**60 + 1, None]) for i in range(8)]
    df = spark.createDataFrame(rows, "episode long, side string, frame_idx long, T array<double>")
    got = {(r.episode, r.frame_idx): r.command for r in run(spark, tmp_path, df, jobs.command_smoothing).collect()}
    want = folds.smooth_commands(bounds.measure(df.withColumn("pos", F.col("frame_idx")), "episode"), "T").collect()
    assert len(got) == len(want) == len(rows)
    for r in want:
        np.testing.assert_allclose(got[r.episode, r.pos], r.command)
