"""Gap filling and smoothing of series, without Python in the row path."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import series as S

KEYS = ("episode", "side")


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    max_gap: int | None,
    keys: Sequence[str] = KEYS,
    pos: str = "pos",
    hold_ends: bool = False,
    poses: Sequence[str] = (),
) -> DataFrame:
    """Linear interpolation of null rows between two valid rows.

    Gaps longer than ``max_gap`` stay; nothing is extrapolated unless ``hold_ends`` repeats the edge
    values. ``poses`` are 4x4 columns: linear in position, spherical in rotation. Adds ``filled``.
    """
    columns = list(columns)
    every = [*columns, *poses]
    ok = F.col(every[0]).isNotNull()
    here = F.when(ok, F.struct(F.col(pos).alias("_at"), *every))
    out = S.scan(
        df,
        keys,
        pos,
        [S.last_valid("_b", here, inclusive=False), S.next_valid("_a", here, inclusive=False)],
    )
    gap = F.col("_a._at") - F.col("_b._at") - 1
    inside = ~ok & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    if max_gap is not None:
        inside = inside & (gap <= max_gap)
    t = (F.col(pos) - F.col("_b._at")) / (gap + 1)

    def value(c: str) -> Column:
        v = F.when(inside, (1 - t) * F.col(f"_b.{c}") + t * F.col(f"_a.{c}")).otherwise(F.col(c))
        if hold_ends:
            v = F.coalesce(v, F.when(~ok & F.col("_a").isNull(), F.col(f"_b.{c}")), F.when(~ok, F.col(f"_a.{c}")))
        return v

    new = {c: value(c) for c in columns}
    for c in poses:
        new[c] = F.when(inside, G.interpolate_pose(f"_b.{c}", f"_a.{c}", t)).otherwise(F.col(c))
    return out.withColumns({**new, "filled": F.coalesce(inside, F.lit(False))}).drop("_a", "_b")


def box_mean(df: DataFrame, column: str, size: int, keys: Sequence[str] = KEYS, pos: str = "pos") -> DataFrame:
    """Mean of ``size`` rows with the edge values repeated."""
    before, after = size // 2, size - 1 - size // 2
    value = F.col(column)

    def columns(w):
        span = w.rowsBetween(-before, after)
        return {
            "_sum": F.sum(value).over(span),
            "_l": F.count(F.lit(1)).over(w.rowsBetween(-before, 0)) - 1,
            "_r": F.count(F.lit(1)).over(w.rowsBetween(0, after)) - 1,
            "_first": F.first(value).over(span),
            "_last": F.last(value).over(span),
        }

    out = S.windowed(df, keys, pos, before, after, columns)
    total = (
        F.col("_sum")
        + (F.lit(before) - F.col("_l")) * F.col("_first")
        + (F.lit(after) - F.col("_r")) * F.col("_last")
    )
    return out.withColumn(column, total / F.lit(float(size))).drop("_sum", "_l", "_r", "_first", "_last")


def interpolate_and_smooth(df: DataFrame, column: str, size: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill every null by interpolation, repeat the ends, then a box mean."""
    return box_mean(fill_gaps(df, [column], None, keys, hold_ends=True), column, size, keys)


def suppress_flicker(df: DataFrame, state: str, max_len: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sequential removal of short inner runs of a binary series.

    A short run takes its left neighbour's value only if that neighbour was not itself removed. In a
    streak of short runs every second one is therefore removed, starting with the first, which needs
    only the rank of a run in its streak.
    """
    from framestride.operators import islands as I

    out = I.segments(df, state, keys)
    start = F.col("pos") == F.col("seg.start")
    short = (F.col("seg.len") <= max_len) & F.col("seg.prev").isNotNull() & F.col("seg.next").isNotNull()
    out = S.scan(out, keys, "pos", [S.running_sum("_run", start.cast("long"))])
    out = S.scan(out, keys, "pos", [S.last_valid("_long", F.when(~short, F.col("_run")))])
    removed = short & ((F.col("_run") - F.coalesce(F.col("_long"), F.lit(0)) - 1) % 2 == 0)
    return out.withColumn(state, F.when(removed, F.col("seg.prev")).otherwise(F.col(state))).drop("seg", "_run", "_long")


def grasp_from_distance(
    df: DataFrame, distance: str, threshold: float, size: int = 5, max_flicker: int = 5, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Grasp state from the fingertip distance; rows without a hand stay without a state.

    Series with fewer than three distances keep no state.
    """
    out = S.scan(df.withColumn("_d", F.col(distance)), keys, "pos", [S.total("_known", F.count(distance))])
    out = box_mean(fill_gaps(out, ["_d"], None, keys, hold_ends=True), "_d", size, keys)
    out = out.withColumn("grasp_state", (F.col("_d") < threshold).cast("int"))
    out = suppress_flicker(out, "grasp_state", max_flicker, keys)
    shown = F.when(F.col(distance).isNotNull() & (F.col("_known") >= 3), F.col("grasp_state"))
    return out.withColumn("grasp_state", shown).drop("_d", "_known", "filled")


def _savgol_weights(size: int, order: int) -> np.ndarray:
    """Row r: weights of the window samples for the polynomial value at sample r."""
    x = np.arange(size, dtype=float) - size // 2
    a = np.vander(x, order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def savitzky_golay(
    df: DataFrame,
    columns: Sequence[str],
    size: int = 21,
    order: int = 2,
    keys: Sequence[str] = (*KEYS, "segment"),
    pos: str = "at",
    min_rows: int = 6,
) -> DataFrame:
    """Polynomial smoothing of each segment; the ends use the polynomial of the edge window.

    ``pos`` counts from 0 inside the segment and values have no nulls. A segment shorter than the
    window uses the largest odd window that fits; below 5 rows, or below ``min_rows``, it is unchanged.
    """
    size += 1 - size % 2
    reach = size - 1

    def windows(w):
        span = w.rowsBetween(-reach, reach)
        return {
            **{f"_w_{c}": F.collect_list(c).over(span) for c in columns},
            "_left": F.count(F.lit(1)).over(w.rowsBetween(-reach, -1)),
        }

    out = S.scan(df, keys, pos, [S.total("_n", F.count(F.lit(1)))])
    out = S.windowed(out, keys, pos, reach, reach, windows)
    n, at = F.col("_n"), F.col(pos)
    used = F.least(F.lit(size), n - (n + 1) % 2).cast("int")
    start = F.greatest(F.lit(0), F.least(at - F.floor(used / 2), n - used))
    row = (at - start).cast("int")
    first = (F.col("_left") - row).cast("int")
    out = out.withColumns({"_used": used, "_row": row, "_from": first})
    weights = F.lit(None).cast("array<double>")
    for w in range(5, size + 1, 2):
        flat = F.array(*[F.lit(float(v)) for v in _savgol_weights(w, min(order, w - 2)).ravel()])
        weights = F.when(F.col("_used") == w, F.slice(flat, F.col("_row") * w + 1, F.lit(w))).otherwise(weights)
    out = out.withColumn("_c", weights)
    new = {}
    for c in columns:
        part = F.slice(f"_w_{c}", F.col("_from") + 1, F.greatest(F.col("_used"), F.lit(1)))
        total = F.aggregate(F.zip_with(part, "_c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        new[c] = F.when((F.col("_used") >= 5) & (n >= min_rows), total).otherwise(F.col(c))
    return out.withColumns(new).drop("_n", "_left", "_used", "_row", "_from", "_c", *[f"_w_{c}" for c in columns])
