"""Recursions that forget their start, cut into chunks, against the plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.operators import folds
from framestride.operators.bounds import measure
from framestride.session import CHUNK_ROWS


def axes_loop(rotations, ax, ay):
    out, state = [], None
    for m in rotations:
        if m is None:
            state = None
            out.append(None)
            continue
        x, y = (m[:, i] / (np.linalg.norm(m[:, i]) + 1e-6) for i in (0, 1))
        if state is None:
            state = (x, y)
        else:
            moved = []
            for old, new, a in ((state[0], x, ax), (state[1], y, ay)):
                new = -new if old @ new < 0 else new
                v = (1 - a) * old + a * new
                moved.append(v / (np.linalg.norm(v) + 1e-6))
            state = tuple(moved)
        z = np.cross(*state)
        z = z / (np.linalg.norm(z) + 1e-6)
        out.append(np.column_stack([state[0], np.cross(z, state[0]), z]))
    return out


def commands_loop(poses, share, step):
    out, last = [], None
    for m in poses:
        if m is not None:
            last = m.copy() if last is None else folds.smooth_command(last, m, share, share, step, None)
        out.append(None if m is None else last)
    return out


def frame(spark, matrices, episode="a"):
    rows = [(episode, "r", i, None if m is None else m.ravel().tolist()) for i, m in enumerate(matrices)]
    return spark.createDataFrame(rows, "episode string, side string, pos int, M array<double>")


def same(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        assert (g is None) == (w is None), i
        if w is not None:
            np.testing.assert_allclose(g, w.ravel(), atol=1e-9, err_msg=str(i))


def column(df, name):
    return [r[name] for r in df.orderBy("pos").collect()]


@pytest.fixture
def chunks(spark):
    yield lambda rows: spark.conf.set(CHUNK_ROWS, str(rows))
    spark.conf.unset(CHUNK_ROWS)


def turning(n, seed, flips=(), gaps=()):
    rng = np.random.default_rng(seed)
    out, v = [], np.zeros(3)
    for i in range(n):
        v = v + rng.normal(0, 0.05, 3)
        m = folds._rotation(v)
        for at, columns in flips:
            if i >= at:
                m = m * np.where(np.isin(range(3), columns), -1.0, 1.0)
        out.append(None if i in gaps else m)
    return out


@pytest.mark.parametrize("rows", [5, 60, 250])
def test_axes_in_chunks(spark, chunks, rows):
    chunks(rows)
    # After row 130 the x axes point the other way for good, after row 300 the y axes too; row 420 restarts.
    m = turning(500, 3, flips=[(130, [0]), (300, [1])], gaps={420, 250, 251})
    same(column(folds.smooth_axes(frame(spark, m), "M", 0.4, 0.3), "M"), axes_loop(m, 0.4, 0.3))


def test_axes_of_a_measured_series(spark):
    m = turning(40, 4, gaps={7})
    same(column(folds.smooth_axes(measure(frame(spark, m), "episode"), "M"), "M"), axes_loop(m, 0.15, 0.15))


def poses(n, seed, jump=None):
    rng = np.random.default_rng(seed)
    out, p, v = [], np.zeros(3), np.zeros(3)
    for i in range(n):
        p, v = p + rng.normal(0, 0.01, 3), v + rng.normal(0, 0.03, 3)
        m = np.eye(4)
        m[:3, :3] = folds._rotation(v)
        m[:3, 3] = p + (0 if jump is None or i < jump else 50.0)
        out.append(None if i % 37 == 5 else m)
    return out


@pytest.mark.parametrize("rows, jump", [(5, None), (200, None), (100, 150)])
def test_commands_in_chunks(spark, chunks, rows, jump):
    """A jump of 50 m takes longer to catch up with than every chunk: those series are folded in order."""
    chunks(rows)
    m = poses(700, 5, jump)
    same(column(folds.smooth_commands(frame(spark, m), "M"), "command"), commands_loop(m, 0.5, 0.05))


def test_series_are_settled_one_by_one(spark, chunks):
    """One series needs the fold in order, another one not; null keys are keys."""
    chunks(100)
    far, near = poses(500, 6, 120), poses(500, 7)
    df = frame(spark, far, "far").unionByName(frame(spark, near, None))
    out = folds.smooth_commands(df, "M")
    same(column(out.where("episode = 'far'"), "command"), commands_loop(far, 0.5, 0.05))
    same(column(out.where("episode is null"), "command"), commands_loop(near, 0.5, 0.05))


def test_settled_series_are_not_folded_in_order(spark, chunks, monkeypatch):
    chunks(250)
    folded = []
    plain = folds.stream_fold
    monkeypatch.setattr(folds, "stream_fold", lambda df, keys, order, *a: folded.append(list(order)) or plain(df, keys, order, *a))
    folds.smooth_axes(frame(spark, turning(1000, 8, flips=[(100, [0, 1])])), "M", 0.4, 0.3).count()
    assert folded == [["_chunk"]]


def test_empty_series(spark, chunks):
    chunks(5)
    none = frame(spark, [np.eye(4)]).where(F.lit(False))
    assert folds.smooth_commands(none, "M").count() == 0
    assert column(folds.smooth_axes(frame(spark, [None] * 12), "M"), "M") == [None] * 12
