"""Run-length segments and the filters built on them.

Input frames are keyed by ``keys`` with a dense zero-based position ``pos``. The segment columns are
computed by two scans, so a run may cross any number of chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.operators import series as S


def segments(
    df: DataFrame, value: Column | str, keys: Sequence[str] = ("episode",), pos: str = "pos", carry: Sequence[str] = ()
) -> DataFrame:
    """Add ``seg``: start, end, length, value, neighbouring values and the ``carry`` columns at both ends."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    df = S.scan(df.withColumn("_v", value), keys, pos, [S.lag("_p", "_v"), S.lead("_n", "_v")])
    first = F.col("_p").isNull() | (F.col("_p") != F.col("_v"))
    last = F.col("_n").isNull() | (F.col("_n") != F.col("_v"))
    at = [F.col(pos).alias("at"), *[F.col(c).alias(c) for c in carry]]
    df = S.scan(
        df,
        keys,
        pos,
        [
            S.last_valid("_s", F.when(first, F.struct(F.col("_p").alias("side"), *at))),
            S.next_valid("_e", F.when(last, F.struct(F.col("_n").alias("side"), *at))),
        ],
    )
    seg = F.struct(
        F.col("_s.at").alias("start"),
        F.col("_e.at").alias("end"),
        (F.col("_e.at") - F.col("_s.at") + 1).alias("len"),
        F.col("_v").alias("value"),
        F.col("_s.side").alias("prev"),
        F.col("_e.side").alias("next"),
        *[F.col(f"_s.{c}").alias(f"{c}_start") for c in carry],
        *[F.col(f"_e.{c}").alias(f"{c}_end") for c in carry],
    )
    return df.withColumn("seg", seg).drop("_v", "_p", "_n", "_s", "_e")


def segment_table(df: DataFrame, value: Column | str, keys: Sequence[str] = ("episode",), pos: str = "pos") -> DataFrame:
    """One row per run: start, end, length and value."""
    out = segments(df, value, keys, pos)
    return out.where(F.col(pos) == F.col("seg.start")).select(
        *keys, "seg.start", "seg.end", "seg.len", F.col("seg.value").alias("value")
    )


def fill_short_gaps(df: DataFrame, mask: str, max_gap: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Turn False runs of at most ``max_gap`` rows between True rows into True."""
    out = segments(df, mask, keys)
    bounded = F.col("seg.prev").isNotNull() & F.col("seg.next").isNotNull()
    return out.withColumn(mask, F.col(mask) | (bounded & (F.col("seg.len") <= max_gap))).drop("seg")


def drop_short_runs(df: DataFrame, mask: str, max_len: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Turn True runs of at most ``max_len`` rows into False."""
    out = segments(df, mask, keys)
    return out.withColumn(mask, F.col(mask) & (F.col("seg.len") > max_len)).drop("seg")


def median_filter(df: DataFrame, value: str, size: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Median of ``size`` rows with the edge values repeated, truncated to an integer."""
    before, after = size // 2, size - 1 - size // 2

    def columns(w):
        return {
            "_w": F.collect_list(value).over(w.rowsBetween(-before, after)),
            "_l": F.count(F.lit(1)).over(w.rowsBetween(-before, -1)),
        }

    out = S.windowed(df, keys, "pos", before, after, columns)
    window = F.col("_w")
    left = F.lit(before) - F.col("_l")
    right = F.lit(size) - left - F.size(window)
    padded = F.array_sort(
        F.concat(
            F.array_repeat(F.get(window, F.lit(0)), left.cast("int")),
            window,
            F.array_repeat(F.element_at(window, -1), right.cast("int")),
        )
    )
    middle = (F.get(padded, F.lit((size - 1) // 2)) + F.get(padded, F.lit(size // 2))) / 2
    return out.withColumn(value, middle.cast("int")).drop("_w", "_l")


def close_mask(df: DataFrame, mask: str, size: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Dilation then erosion with a flat kernel whose anchor is ``size // 2``."""
    before, after = size // 2, size - 1 - size // 2
    out = df.withColumnRenamed(mask, "_m0")
    out = S.windowed(out, keys, "pos", before, after, lambda w: {"_m1": F.max("_m0").over(w.rowsBetween(-before, after))})
    out = S.windowed(out, keys, "pos", before, after, lambda w: {mask: F.min("_m1").over(w.rowsBetween(-before, after))})
    return out.drop("_m0", "_m1")


def merge_short_runs(df: DataFrame, value: str, min_len: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Runs shorter than ``min_len`` take the value of the right neighbour, else the left one.

    All decisions use the original runs; a merged run is not looked at again.
    """
    out = segments(df, value, keys)
    merged = F.coalesce(F.col("seg.next"), F.col("seg.prev"), F.col(value))
    return out.withColumn(value, F.when(F.col("seg.len") < min_len, merged).otherwise(F.col(value))).drop("seg")


def delay_onset(df: DataFrame, mask: str, offset: int, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Delay the start of each True run by ``offset`` rows."""
    if offset <= 0:
        return df
    out = segments(df, mask, keys)
    return out.withColumn(mask, F.col(mask) & (F.col("pos") >= F.col("seg.start") + offset)).drop("seg")


def longest_run(df: DataFrame, mask: Column, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Start and end of the longest True run per series, (-1, -1) without one; first one on a tie."""
    runs = segment_table(df, mask, keys)
    best = F.max_by(
        F.struct("start", "end"), F.when(F.col("value"), F.struct(F.col("len"), (-F.col("start")).alias("first")))
    )
    return (
        runs.groupBy(*keys)
        .agg(best.alias("b"))
        .select(
            *keys,
            F.coalesce("b.start", F.lit(-1).cast("long")).alias("start"),
            F.coalesce("b.end", F.lit(-1).cast("long")).alias("end"),
        )
    )


def runs_of_presence(df: DataFrame, present: Column, min_frames: int, keys: Sequence[str]) -> DataFrame:
    """Keep rows whose presence run has at least ``min_frames`` rows; adds ``kept``."""
    out = segments(df, present, keys)
    return out.withColumn("kept", F.col("seg.value") & (F.col("seg.len") >= min_frames)).drop("seg")
