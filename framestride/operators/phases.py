"""Motion phases of a recording: stops, modes, refinement by hand speed, phase windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.operators import islands as I
from framestride.operators import series as S
from framestride.operators.bounds import bound, with_bound

# Mode codes and names.
STOP, FORWARD, ROTATE, TRANSITION, FINISHED = 0, 1, 2, 3, 4
MODE_NAMES = {0: "STOP", 1: "FORWARD", 2: "ROTATE", 3: "TRANSITION", 4: "FINISHED"}
GROUPS = {"manipulation": (0, 4), "navigation": (1, 2), "transition": (3,), "raw_manipulation": (0, 3, 4)}


@dataclass(frozen=True)
class PhaseConfig:
    """Default thresholds of phase detection."""

    v_stop: float = 0.03
    w_stop: float = 0.15
    hold: int = 15
    debounce: int = 8
    min_on: int = 75
    yaw_veto_deg: float = 20.0
    stop_offset: int = 10
    transition_offset: int = 10
    min_run: int = 30
    w_rotate: float = 0.10
    v_rotate_max: float = 0.08
    v_walk: float = 0.10
    median: int = 21
    hesitation: int = 80
    hand_speed: float = 0.15
    wait: int = 5
    manual_offset: int = 10
    finished: int = 30


def stop_mask(df: DataFrame, c: PhaseConfig, name: str = "stop") -> DataFrame:
    """Slow in both speeds, short interruptions filled, kept from ``hold`` frames on."""
    out = df.withColumn(name, F.coalesce((F.col("v") < c.v_stop) & (F.col("w") < c.w_stop), F.lit(False)))
    return I.drop_short_runs(I.fill_short_gaps(out, name, c.debounce), name, c.hold - 1)


def settle_stops(df: DataFrame, c: PhaseConfig, name: str = "stop", yaw: str = "yaw_unwrapped_deg") -> DataFrame:
    """Drop short stops and stops with a large yaw change."""
    out = I.segments(I.drop_short_runs(df, name, c.min_on - 1), name, carry=[yaw])
    turn = F.abs(F.col(f"seg.{yaw}_end") - F.col(f"seg.{yaw}_start"))
    return out.withColumn(name, F.col(name) & ~F.coalesce(turn >= c.yaw_veto_deg, F.lit(False))).drop("seg")


def modes(df: DataFrame, c: PhaseConfig, stop: str = "stop") -> DataFrame:
    """STOP, FORWARD or ROTATE per frame, smoothed, with shifted boundaries."""
    rotate = (F.col("w") >= c.w_rotate) & (F.col("v") <= 2 * c.v_rotate_max)
    base = F.when(F.col(stop), STOP).when(rotate, ROTATE).otherwise(FORWARD)
    out = I.median_filter(df.withColumn("mode", base), "mode", c.median)
    out = I.merge_short_runs(out, "mode", c.min_run)
    out = absorb_hesitation(out, c.hesitation)
    out = shift_boundaries(out, c.transition_offset)
    out = I.median_filter(out, "mode", c.median)
    return I.merge_short_runs(out, "mode", c.min_run)


def absorb_hesitation(df: DataFrame, limit: int) -> DataFrame:
    """The first moving run becomes ROTATE when it is a short FORWARD before a ROTATE."""
    out = I.segments(df, "mode")
    moving = F.when(F.col("mode") != STOP, F.col("pos"))
    out = S.scan(out, ["episode"], "pos", [S.total("_first", F.min(moving), F.min)])
    hit = (
        (F.col("seg.start") == F.col("_first"))
        & (F.col("mode") == FORWARD)
        & (F.col("seg.next") == ROTATE)
        & (F.col("seg.len") < limit)
    )
    return out.withColumn("mode", F.when(hit, ROTATE).otherwise(F.col("mode"))).drop("seg", "_first")


def shift_boundaries(df: DataFrame, offset: int) -> DataFrame:
    """Each run starts later: its first frames keep the mode of the run before."""
    if offset <= 0:
        return df
    out = I.segments(df, "mode")
    shift = F.least(F.lit(offset), F.col("seg.len") - 1)
    early = F.col("seg.prev").isNotNull() & (F.col("pos") - F.col("seg.start") < shift)
    return out.withColumn("mode", F.when(early, F.col("seg.prev")).otherwise(F.col("mode"))).drop("seg")


def refine_by_hand_speed(df: DataFrame, c: PhaseConfig, speed: str = "hand_speed") -> DataFrame:
    """Trim stops to the part where the hands are calm; the rest becomes TRANSITION.

    A missing hand speed counts as 99. The entry cut is the first frame of the run whose next
    ``wait`` frames are calm on average, the exit cut the last frame whose previous ones are.
    """
    n = c.wait
    df = df.withColumn("_h", F.coalesce(F.col(speed), F.lit(99.0)))
    out = S.windowed(
        df,
        ["episode"],
        "pos",
        n,
        n,
        lambda w: {
            "_ahead": F.avg("_h").over(w.rowsBetween(0, n - 1)),
            "_behind": F.avg("_h").over(w.rowsBetween(1 - n, 0)),
        },
    )
    out = I.segments(out, "mode")
    at, pos = F.col("pos") - F.col("seg.start"), F.col("pos")
    calm_in = (at < F.col("seg.len") - n) & (F.col("_ahead") < c.hand_speed)
    calm_out = (at >= n) & (F.col("_behind") < c.hand_speed)
    out = S.scan(
        out,
        ["episode"],
        "pos",
        [
            S.last_valid("_in_before", F.when(calm_in, pos), inclusive=False),
            S.next_valid("_out_after", F.when(calm_out, pos), inclusive=False),
        ],
    )
    start, end = F.col("seg.start"), F.col("seg.end")
    is_in = calm_in & ~F.coalesce(F.col("_in_before") >= start, F.lit(False))
    is_out = calm_out & ~F.coalesce(F.col("_out_after") <= end, F.lit(False))
    out = S.scan(
        out,
        ["episode"],
        "pos",
        [S.last_valid("_in", F.when(is_in, pos)), S.next_valid("_out", F.when(is_out, pos))],
    )
    entered = F.coalesce(F.col("_in") >= start, F.lit(False))
    left = F.coalesce(F.col("_out") <= end, F.lit(False))
    trim = (
        (~entered & (at < F.col("seg.len") - n))
        | (entered & (pos - F.col("_in") < c.manual_offset))
        | (~left & (at >= n))
        | (left & (F.col("_out") - pos < c.manual_offset))
    )
    mode = F.when((F.col("mode") == STOP) & trim, TRANSITION).otherwise(F.col("mode"))
    return out.withColumn("mode", mode).drop(
        "_h", "_ahead", "_behind", "seg", "_in_before", "_out_after", "_in", "_out"
    )


def mark_finished(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` frames of the last run that is not a TRANSITION become FINISHED."""
    out = I.segments(df, "mode")
    steady = F.when(F.col("mode") != TRANSITION, F.col("pos"))
    out = S.scan(out, ["episode"], "pos", [S.total("_end", F.max(steady), F.max)])
    hit = (F.col("seg.end") == F.col("_end")) & (F.col("pos") > F.col("_end") - n)
    return out.withColumn("mode", F.when(hit, FINISHED).otherwise(F.col("mode"))).drop("seg", "_end")


def detect(df: DataFrame, c: PhaseConfig | None = None, hand_speed: str | None = None) -> DataFrame:
    """The whole phase detection over ``pos``, ``v``, ``w`` and ``yaw_unwrapped_deg``."""
    c = c or PhaseConfig()
    out = I.close_mask(stop_mask(df, c), "stop", c.debounce)
    out = I.delay_onset(settle_stops(out, c), "stop", c.stop_offset)
    out = modes(out, c)
    if hand_speed:
        out = refine_by_hand_speed(out, c, hand_speed)
    out = mark_finished(out, c.finished)
    return out.withColumn("mode_str", mode_name(F.col("mode")))


def mode_name(mode: Column) -> Column:
    out = F.lit("UNKNOWN")
    for code, name in MODE_NAMES.items():
        out = F.when(mode == code, name).otherwise(out)
    return out


def mode_counts(df: DataFrame) -> DataFrame:
    """Frames per mode and in navigation, duration in seconds."""
    m = F.col("mode")
    return df.groupBy("episode").agg(
        *[F.count_if(m == code).alias(f"{name.lower()}_frames") for code, name in MODE_NAMES.items()],
        F.count_if(m.isin(FORWARD, ROTATE)).alias("navigation_frames"),
    )


def phase_windows(df: DataFrame) -> DataFrame:
    """Start and end of each run per mode."""
    return I.segment_table(df, "mode").withColumnRenamed("value", "mode")


def frames_in_windows(frames: DataFrame, windows: DataFrame, group: str) -> DataFrame:
    """Distinct frames that lie in a window of a mode group.

    Windows are put at their starts into the order of the frames. A frame lies in a window exactly if
    the furthest end among the windows that start at or before it reaches it, so a running maximum
    decides each frame once: the work is linear in frames plus windows, however the windows overlap.
    Windows given from end to start are turned round; rows without an episode or index are left out.
    """
    end = F.greatest("start", "end")
    events = frames.select("episode", F.col("frame_idx").cast("long").alias("frame_idx"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    starts = windows.where(F.col("mode").isin(*GROUPS[group])).select(
        "episode", F.least("start", "end").cast("long").alias("frame_idx"), F.lit(0).alias("_kind"), end.cast("long").alias("_end")
    )
    rows = events.union(starts).where(F.col("episode").isNotNull() & F.col("frame_idx").isNotNull())
    rows = rows.withColumn("episode", F.col("episode").alias("episode", metadata={}))
    known = [bound(side, ["episode"]) for side in (frames, windows)]
    if None not in known:
        rows = with_bound(rows, "episode", sum(known))
    before = S.lag("_before", F.when(F.col("_kind") == 1, F.col("frame_idx")))
    out = S.scan(rows, ["episode"], ["frame_idx", "_kind"], [S.running_max("_reach", "_end"), before])
    repeated = F.coalesce(F.col("_before") == F.col("frame_idx"), F.lit(False))
    return out.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("frame_idx")) & ~repeated).select("episode", "frame_idx")


def reference_window(df: DataFrame, most: int = 60, least: int = 30) -> DataFrame:
    """Frames before the first manipulation frame, topped up from it when too few.

    Returns the selected frames with their rank in the window; the reference is its last frame.
    """
    raw = F.col("mode").isin(*GROUPS["raw_manipulation"])
    out = S.scan(
        df.withColumn("_raw", raw),
        ["episode"],
        "pos",
        [S.total("_first", F.min(F.when(raw, F.col("pos"))), F.min), S.running_sum("_seen", raw.cast("long"))],
    )
    before = F.least(F.col("_first"), F.lit(most))
    pre = (F.col("pos") < F.col("_first")) & (F.col("pos") >= F.col("_first") - before)
    rank = (
        F.when(pre, F.col("pos") - (F.col("_first") - before))
        .when(F.col("_raw") & (F.col("_seen") <= least - before), before + F.col("_seen") - 1)
    )
    return out.withColumn("window_rank", rank).where("window_rank is not null").drop("_raw", "_first", "_seen")
