"""Nearest as-of join of two streams and the summaries of a synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.operators import series as S
from framestride.operators.bounds import bound, with_bound
from framestride.operators.skew import exact_quantiles
from framestride.session import chunk_rows, stage


def nearest(
    video: DataFrame,
    tracking: DataFrame,
    keys: Sequence[str] = ("episode",),
    ts: str = "ts",
    tracking_ts: str = "tracking_ts",
    payload: Sequence[str] = (),
) -> DataFrame:
    """Nearest as-of join in both directions; a tie goes to the earlier tracking row.

    Every video row is kept. Both streams become one series ordered by time; the tracking row before
    and the one after each video row come from one forward and one backward scan, so there is no
    range join and nothing is paired within a group.
    """
    keys = list(keys)
    item = F.struct(F.col(tracking_ts).alias("t"), *payload).alias("_t")
    left = video.select(*keys, F.col(ts).cast("long").alias("_ts"), F.struct("*").alias("_v"))
    right = tracking.select(*keys, F.col(tracking_ts).cast("long").alias("_ts"), item)
    both = left.withColumn("_order", F.lit(1)).unionByName(right.withColumn("_order", F.lit(0)), allowMissingColumns=True)
    sizes = [bound(video, keys), bound(tracking, keys)]
    if None not in sizes and sum(sizes) <= chunk_rows(video):
        both, chunked = with_bound(both, keys[0], sum(sizes)), False
    else:
        both, chunked = S.chunk_hot(stage(both), keys, "_ts", chunk_rows(video)), True
    out = S.scan(
        both,
        keys,
        ["_ts", "_order"],
        [S.last_valid("_before", "_t"), S.next_valid("_after", "_t")],
        chunked=chunked,
    ).where(F.col("_order") == 1)
    before = F.abs(F.col("_ts") - F.col("_before.t"))
    after = F.abs(F.col("_after.t") - F.col("_ts"))
    chosen = F.when(after.isNull() | (before <= after), F.col("_before")).otherwise(F.col("_after"))
    out = out.select("_v.*", "_ts", chosen.alias("_c"))
    return out.select(
        *video.columns,
        F.col("_c.t").alias(tracking_ts),
        *[F.col(f"_c.{p}").alias(p) for p in payload],
        (F.col("_c.t") - F.col("_ts")).alias("delta"),
    )


def synchronise(
    video: DataFrame, tracking: DataFrame, tolerance: int, keys: Sequence[str] = ("episode",), **names
) -> DataFrame:
    """Nearest join plus the tolerance flag; rows outside the tolerance are kept."""
    out = nearest(video, tracking, keys, **names)
    return out.withColumn("within_tolerance", F.coalesce(F.abs("delta") <= tolerance, F.lit(False)))


def video_timestamps(pts: DataFrame, base_ns) -> DataFrame:
    """Nanosecond timestamps of video frames from their presentation times."""
    return pts.withColumn("video_timestamp_ns", base_ns + F.rint(F.col("pts_seconds") * F.lit(1e9)).cast("long"))


def select_synced(matches: DataFrame, keep_outliers: bool = False) -> DataFrame:
    """Rows inside the tolerance, or all."""
    return matches if keep_outliers else matches.where("within_tolerance")


def sync_summary(matches: DataFrame, keys: Sequence[str] = ("episode",), per_ms: float = 1e6) -> DataFrame:
    """Counts, largest and mean offset, share within tolerance, PASS or CHECK."""
    ms = F.abs("delta") / F.lit(per_ms)
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("video_frame_count"),
        F.max(ms).alias("sync_max_abs_ms"),
        F.avg(ms).alias("sync_mean_abs_ms"),
        F.avg(F.col("within_tolerance").cast("double")).alias("sync_within_tolerance_ratio"),
        F.when(F.bool_and("within_tolerance"), "PASS").otherwise("CHECK").alias("status"),
    )


def manifest(matches: DataFrame, keep_outliers: bool = False, order: str = "frame_idx") -> DataFrame:
    """All matches with the output index of the kept rows, null for the others."""
    kept = S.densify(select_synced(matches, keep_outliers).select("episode", order), ["episode"], order, "output_index")
    return matches.join(kept, ["episode", order], "left")


def fps_from_duration(frames: DataFrame, ts: str, unit: float, default: float = 10.0) -> DataFrame:
    """(n - 1) / duration rounded half up; the default when it cannot be computed."""
    duration = (F.max(ts) - F.min(ts)) * F.lit(unit)
    n = F.count(ts)
    return frames.groupBy("episode").agg(
        F.when((n >= 2) & (duration > 0), F.floor((n - 1) / duration + F.lit(0.5)).cast("double"))
        .otherwise(F.lit(float(default)))
        .alias("fps")
    )


def fps_from_median_step(frames: DataFrame, ts: str, unit: float, default: float = 30.0) -> DataFrame:
    """Inverse of the median step; the default for a single row."""
    steps = S.scan(frames, ["episode"], "frame_idx", [S.lag("_p", ts)]).withColumn("step", F.col(ts) - F.col("_p"))
    med = exact_quantiles(steps, ["episode"], "step", [0.5], ["median_step"])
    every = frames.groupBy("episode").agg(F.count(F.lit(1)).alias("n_frames"))
    fps = F.coalesce(1 / (F.col("median_step") * F.lit(unit)), F.lit(float(default)))
    return every.join(med, "episode", "left").select("episode", fps.alias("fps"))


def coverage_errors(frames: DataFrame, cache: DataFrame, pts: str = "pts_seconds", eps: float = 1e-8) -> DataFrame:
    """Frames missing on either side of a cache, or with a different time."""
    a = frames.select("episode", "frame_idx", F.col(pts).alias("_a"))
    b = cache.select("episode", "frame_idx", F.col(pts).alias("_b"))
    both = a.join(b, ["episode", "frame_idx"], "full_outer")
    reason = (
        F.when(F.col("_b").isNull(), "missing_in_cache")
        .when(F.col("_a").isNull(), "unknown_frame")
        .when(F.abs(F.col("_a") - F.col("_b")) > eps, "time_differs")
    )
    return both.withColumn("reason", reason).where("reason is not null").select("episode", "frame_idx", "reason")


def monotonic_guard(df: DataFrame, nominal: str, order: str = "frame_idx", name: str = "guarded") -> DataFrame:
    """Strictly increasing timestamps: max(previous + 1, nominal), in closed form."""
    out = S.densify(df, ["episode"], order, "_pos").withColumn("_base", F.col(nominal) - F.col("_pos"))
    out = S.scan(out, ["episode"], order, [S.running_max("_top", "_base")])
    return (
        out.withColumn(name, F.col("_top") + F.col("_pos"))
        .withColumn("adjusted", F.col(name) != F.col(nominal))
        .drop("_pos", "_base", "_top")
    )


def attach_session(frames: DataFrame, sessions: DataFrame, how: str = "inner") -> DataFrame:
    """Per-recording dimension on every frame, salted for very long recordings."""
    return frames.join(sessions, "episode", how)
