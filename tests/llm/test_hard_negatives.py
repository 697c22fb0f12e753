import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framestride.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int"


def expected(rows, every=50):
    good = {}
    for ident, v, label in rows:
        if ident is None or label is None or v is None or None in v or not all(map(math.isfinite, v)):
            continue
        label = (label + 1) % 10 if ident % 7 == 0 else label
        good[ident, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a, la, va in good:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in good if i != a and len(v) == len(va)]
        first = sorted(s for s in scored if s[2] == la)[:5]
        for p, i, _ in first:
            near = sorted(s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(near)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.relabelled(df), F.col("vec_id") % 50 == 0).collect())


def made(seed, n, dim, scale=1.0):
    pick = np.random.default_rng(seed)
    centres = pick.standard_normal((4, dim))
    rows = []
    for k in range(n):
        v = (centres[k % 4] * 0.5 + pick.standard_normal(dim)) * scale
        rows.append((k, v.astype(np.float32).tolist(), int(pick.integers(0, 10)) if k % 3 else 4))
    return rows


@pytest.mark.parametrize("scale", [0.2, 3000.0])
def test_mining_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK", 37)
    rows = made(1, 600, 24, scale)
    rows += [(i, v, label) for i, v, label in rows[:40]]  # repeated rows
    rows += [(1000 + i, v, label) for i, v, label in rows[:60]]  # ties
    rows += [(50, [1.0] * 24, 3), (2000, [1.0, 2.0], 1), (2001, [0.5, 1.0], 1), (2002, [1.0, 1.5], 2), (2050, [], 1), (2051, [], 1), (2052, [], 5)]
    rows += [(None, [1.0] * 24, 1), (3000, None, 1), (3050, [1.0] * 24, None), (3001, [None] + [1.0] * 23, 2), (3002, [math.nan] * 24, 2), (3003, [math.inf] * 24, 2)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for c in ("dim", "vec", "anchor", "score", "found", "rank", "scores", "ids", "columns"):
        df = df.withColumn(c, F.lit("clash"))
    got = mined(df)
    assert got == expected(rows) and len(got) > 100


def test_bounds_drop_rows_before_all_columns_are_read():
    pick = np.random.default_rng(2)
    dim, n = 64, 500
    columns = np.floor(pick.standard_normal((dim, n)) * np.geomspace(400, 1, dim)[:, None])
    block = hard_negatives.Block({"label": 1, "dim": dim, "ids": np.arange(n).tobytes(), "columns": columns.astype(np.int32).tobytes()})
    seen = []

    def keep(least, most, rows):
        seen.append(len(least))
        return most >= hard_negatives._kth(least, 5)

    anchor = np.floor(pick.standard_normal(dim) * np.geomspace(400, 1, dim))
    rows, scores = hard_negatives.Scan(anchor, block).run(keep)
    want = (anchor @ columns).astype(np.int64)
    assert set(np.argsort(-want)[:5]) <= set(rows.tolist()) and (want[rows] == scores).all()
    assert sum(seen[1:]) < 0.5 * n * (len(seen) - 1)


def test_large_components_stay_exact_and_larger_ones_take_no_part(spark):
    rows = [(0, [2.0e5] * 8, 0), (1, [2.0e5] * 7 + [1.99e5], 1), (2, [1.5e5] * 8, 2), (3, [1.0e30] * 8, 2), (4, [1.2e5] * 7 + [1.2e5 + 0.0078125], 2)]
    got = mined(spark.createDataFrame(rows, ROWS))
    assert got == expected([r for r in rows if r[0] != 3]) and len(got) == 2


def test_no_vectors(spark):
    assert mined(spark.createDataFrame([], ROWS)) == []
