"""Series primitives: split plans against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framestride.operators import islands as I
from framestride.operators import series as S
from framestride.operators import skew
from framestride.operators import sync as Y
from framestride.operators.bounds import measure


def series(seed=0, n=160, dense=True):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"episode": np.where(rng.random(n) < 0.7, "a", "b")})
    pdf["pos"] = pdf.groupby("episode").cumcount() if dense else rng.permutation(n * 3)[:n]
    pdf["v"] = np.where(rng.random(n) < 0.4, np.nan, rng.random(n))
    return pdf.sort_values(["episode", "pos"]).reset_index(drop=True)


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    for c in pdf.columns:
        if pdf[c].dtype.kind == "f":
            df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def ordered(df, keys=("episode", "pos")):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("bounded", [True, False])
def test_scans_match_pandas(small_chunks, dense, bounded):
    spark = small_chunks
    if bounded:
        spark.conf.set("framestride.chunkRows", "1000")
    pdf = series(1, dense=dense)
    df = frame(spark, pdf)
    df = measure(df, "episode") if bounded else df
    scans = [
        S.lag("p", "v"), S.lead("n", "v"), S.last_valid("lv", "v"), S.last_valid("lx", "v", False),
        S.next_valid("nv", "v"), S.running_sum("rs", "v"), S.position("at"), S.of_first("first", "pos"),
        S.total("rows", F.count(F.lit(1))), S.running_max("mx", "pos"),
    ]
    got = ordered(S.scan(df, ["episode"], "pos", scans))
    g = pdf.groupby("episode")
    seen = g.v.transform(lambda s: s.notna().cumsum())
    want = pdf.assign(
        p=g.v.shift(), n=g.v.shift(-1), lv=g.v.ffill(), lx=g.v.transform(lambda s: s.ffill().shift()), nv=g.v.bfill(),
        rs=g.v.transform(lambda s: s.fillna(0).cumsum()).where(seen > 0), at=g.cumcount(), first=g.pos.transform("first"),
        rows=g.pos.transform("size"), mx=g.pos.cummax(),
    )
    for c in want.columns[1:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)


def test_empty_and_single_row(small_chunks):
    df = small_chunks.createDataFrame([("a", 0, 1.0)], "episode string, pos int, v double")
    one = S.scan(df, ["episode"], "pos", [S.lag("p", "v"), S.position("at")]).collect()
    assert [(r.p, r.at) for r in one] == [(None, 0)]
    assert S.scan(df.where("v > 5"), ["episode"], "pos", [S.lag("p", "v")]).count() == 0


def test_hot_time_series_is_cut_evenly(small_chunks):
    df = small_chunks.range(100).select(F.lit("a").alias("episode"), (F.col("id") * 1000).alias("ts"))
    sizes = S.chunk_hot(df, ["episode"], "ts", 10).groupBy(S.CHUNK).count().toPandas()["count"]
    assert len(sizes) == 10 and sizes.max() <= 11


def test_hot_quantiles_are_exact(small_chunks):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"episode": ["a"] * 300 + ["b"] * 4, "v": np.r_[rng.normal(0, 100, 299), 0.0, -1, 2, 2, 7]})
    got = skew.exact_quantiles(frame(small_chunks, pdf), ["episode"], "v", [0.0, 0.05, 0.5, 0.95, 1.0], list("abcde"))
    got = got.toPandas().set_index("episode").sort_index()
    want = pdf.groupby("episode").v.quantile([0.0, 0.05, 0.5, 0.95, 1.0]).unstack()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-12)



def nearest_brute(v, t):
    return [min(t, key=lambda x: (abs(x - a), x)) for a in v]


@pytest.mark.parametrize("bounded", [True, False])
def test_nearest_join_against_brute_force(small_chunks, bounded):
    if bounded:
        small_chunks.conf.set("framestride.chunkRows", "1000")
    rng = np.random.default_rng(5)
    v, t = np.sort(rng.choice(1000, 60, False)), np.sort(rng.choice(1000, 40, False))
    video = small_chunks.createDataFrame(pd.DataFrame({"episode": "a", "frame_idx": range(60), "ts": v}))
    track = small_chunks.createDataFrame(pd.DataFrame({"episode": "a", "tracking_ts": t}))
    if bounded:
        video, track = measure(video, "episode"), measure(track, "episode")
    got = Y.nearest(video, track).toPandas().sort_values("frame_idx")
    assert got.tracking_ts.tolist() == nearest_brute(v, t)


def test_nearest_tie_takes_the_earlier_row(spark):
    video = spark.createDataFrame([("a", 0, 150)], "episode string, frame_idx int, ts long")
    track = spark.createDataFrame([("a", 100), ("a", 200)], "episode string, tracking_ts long")
    out = Y.synchronise(video, track, 50).first()
    assert (out.tracking_ts, out.delta, out.within_tolerance) == (100, -50, True)


def mask_case(spark, bits, name="m"):
    return spark.createDataFrame([("a", i, bool(b)) for i, b in enumerate(bits)], f"episode string, pos int, {name} boolean")


def bits(df, name="m"):
    return [int(r[name]) for r in df.orderBy("pos").collect()]


def test_fixture_masks(small_chunks):
    case = mask_case(small_chunks, [1, 0, 0, 1, 1, 0, 1])
    assert bits(I.fill_short_gaps(case, "m", 2)) == [1] * 7
    assert bits(I.fill_short_gaps(mask_case(small_chunks, [0, 0, 1, 0, 1]), "m", 2)) == [0, 0, 1, 1, 1]
    assert bits(I.drop_short_runs(case, "m", 1)) == [0, 0, 0, 1, 1, 0, 0]
    assert bits(I.delay_onset(case, "m", 1)) == [0, 0, 0, 0, 1, 0, 0]


def test_merge_takes_the_right_neighbour_without_cascade(small_chunks):
    values = [0] * 3 + [1] + [2] * 4
    df = small_chunks.createDataFrame([("a", i, v) for i, v in enumerate(values)], "episode string, pos int, v int")
    out = [r.v for r in I.merge_short_runs(df, "v", 2).orderBy("pos").collect()]
    assert out == [0, 0, 0, 2, 2, 2, 2, 2]
    chain = small_chunks.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 2, 2)], "episode string, pos int, v int")
    assert [r.v for r in I.merge_short_runs(chain, "v", 2).orderBy("pos").collect()] == [1, 2, 1]


def test_median_filter_repeats_edges(small_chunks):
    x = np.random.default_rng(2).integers(0, 4, 40)
    df = small_chunks.createDataFrame([("a", i, int(v)) for i, v in enumerate(x)], "episode string, pos int, v int")
    got = [r.v for r in I.median_filter(df, "v", 7).orderBy("pos").collect()]
    p = np.pad(x, 3, mode="edge")
    assert got == [int(np.median(p[i : i + 7])) for i in range(len(x))]


def test_closing_with_an_even_kernel(small_chunks):
    m = np.random.default_rng(4).random(50) < 0.3
    got = bits(I.close_mask(mask_case(small_chunks, m), "m", 4))
    span = lambda a, i: a[max(0, i - 2) : i + 2]
    d = np.array([span(m, i).max() for i in range(50)])
    assert got == [int(span(d, i).min()) for i in range(50)]


def test_monotonic_guard_matches_the_loop(small_chunks):
    nominal = np.random.default_rng(8).integers(0, 30, 40)
    df = small_chunks.createDataFrame([("a", i, int(v)) for i, v in enumerate(nominal)], "episode string, frame_idx int, n long")
    want, prev = [], -(10**9)
    for v in nominal:
        prev = max(prev + 1, int(v))
        want.append(prev)
    assert [r.guarded for r in Y.monotonic_guard(df, "n").orderBy("frame_idx").collect()] == want
