"""Velocities, unwrapped angles and trajectory diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import series as S
from framestride.operators.skew import exact_quantiles

_TWO_PI = 6.283185307179586
_PI = 3.141592653589793


def wrap(angle: Column) -> Column:
    """Angle in radians wrapped to [-pi, pi)."""
    return F.pmod(angle + F.lit(_PI), F.lit(_TWO_PI)) - F.lit(_PI)


def unwrap(df: DataFrame, angle: str, keys: Sequence[str] = ("episode",), order: str = "frame_idx") -> DataFrame:
    """Continuous angle: each step moved to (-pi, pi] and summed up (W08). Adds ``<angle>_unwrapped``."""
    out = S.scan(df, keys, order, [S.lag("_p", angle)])
    d = F.col(angle) - F.col("_p")
    step = wrap(d)
    # Half a turn keeps the sign of the original step.
    step = F.when((step == F.lit(-_PI)) & (d > 0), F.lit(_PI)).otherwise(step)
    change = F.when(F.col("_p").isNull(), F.col(angle)).when(F.abs(d) < F.lit(_PI), d).otherwise(step)
    out = out.withColumn("_d", change)
    return S.scan(out, keys, order, [S.running_sum(f"{angle}_unwrapped", "_d")]).drop("_p", "_d")


def from_first(df: DataFrame, columns: Sequence[str], order: str = "frame_idx") -> DataFrame:
    """Difference to the first frame of the recording, as ``delta_<column>``."""
    out = S.scan(df, ["episode"], order, [S.of_first(f"_f_{c}", c) for c in columns])
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"_f_{c}") for c in columns}).drop(
        *[f"_f_{c}" for c in columns]
    )


def wrapped_degrees(delta: Column) -> Column:
    return F.degrees(wrap(F.radians(delta)))


def slam_rates(df: DataFrame, dt: float, yaw: str = "yaw", order: str = "frame_idx") -> DataFrame:
    """Linear speed and absolute yaw rate with a fixed frame period, 0 on the first frame."""
    out = unwrap(df, yaw, order=order)
    out = S.scan(out, ["episode"], order, [S.lag("_b", F.struct("x", "y", "z", f"{yaw}_unwrapped"))])
    step = G.norm([F.col(c) - F.col(f"_b.{c}") for c in "xyz"])
    turn = F.abs(F.col(f"{yaw}_unwrapped") - F.col(f"_b.{yaw}_unwrapped"))
    zero = F.lit(0.0)
    return out.withColumns(
        {"v": F.coalesce(step / F.lit(dt), zero), "w": F.coalesce(turn / F.lit(dt), zero)}
    ).drop("_b")


def head_rates(df: DataFrame, pose: str, ts_ns: str, order: str = "frame_idx") -> DataFrame:
    """Speed and geodesic turn rate with the measured period, at least 1e-6 s."""
    out = S.scan(df, ["episode"], order, [S.lag("_b", F.struct(F.col(pose).alias("T"), F.col(ts_ns).alias("ts")))])
    dt = F.greatest((F.col(ts_ns) - F.col("_b.ts")) / F.lit(1e9), F.lit(1e-6))
    step = G.norm(G.sub(G.translation(pose), G.translation("_b.T")))
    turn = F.radians(G.rotation_angle(G.rotation("_b.T"), G.rotation(pose)))
    zero = F.lit(0.0)
    return out.withColumns(
        {"linear_speed_mps": F.coalesce(step / dt, zero), "angular_speed_rps": F.coalesce(turn / dt, zero)}
    ).drop("_b")


def linear_velocity(
    df: DataFrame, point: Sequence[str], dt: Column, mode: str, keys: Sequence[str] = ("episode", "side"),
    order: str = "pos",
) -> DataFrame:
    """Velocity vector from the previous point.

    ``reset``: zero on the first row of a run of valid rows. ``compact``: the previous valid row is
    used across gaps and the first valid row has no velocity.
    """
    xs = list(point)
    ok = F.col(xs[0]).isNotNull()
    here = F.when(ok, F.struct(*xs))
    if mode == "reset":
        out = S.scan(df, keys, order, [S.lag("_b", here)])
        missing: Column = F.lit(0.0)
    elif mode == "compact":
        out = S.scan(df, keys, order, [S.last_valid("_b", here, inclusive=False)])
        missing = F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown mode: {mode}")
    v = {
        f"v_{c}": F.when(ok, F.when(F.col("_b").isNotNull(), (F.col(c) - F.col(f"_b.{c}")) / dt).otherwise(missing))
        for c in xs
    }
    return out.withColumns(v).drop("_b")


def measured_velocity(
    df: DataFrame, point: Sequence[str], ts_ns: str, keys: Sequence[str] = ("episode", "side"), order: str = "pos"
) -> DataFrame:
    """Velocity with the measured period; zero when this or the previous row has no point."""
    xs = list(point)
    out = S.scan(df, keys, order, [S.lag("_b", F.struct(*xs, ts_ns))])
    dt = F.greatest((F.col(ts_ns) - F.col(f"_b.{ts_ns}")) / F.lit(1e9), F.lit(1e-6))
    return out.withColumns(
        {f"v_{c}": F.coalesce((F.col(c) - F.col(f"_b.{c}")) / dt, F.lit(0.0)) for c in xs}
    ).drop("_b")


def angular_velocity(
    df: DataFrame, pose: str, dt: float, keys: Sequence[str] = ("episode", "side"), order: str = "pos"
) -> DataFrame:
    """Rotation vector of the relative rotation per second; zero after a gap."""
    out = S.scan(df, keys, order, [S.lag("_b", pose)])
    out = out.withColumn("_r", F.array(*G.matmul3(G.transpose3(G.rotation("_b")), G.rotation(pose))))
    out = out.withColumn("_w", G.log_map("_r"))
    vector = [F.get("_w", F.lit(i)) for i in range(3)]
    zero = F.lit(0.0)
    return out.withColumns(
        {
            f"w_{a}": F.when(F.col(pose).isNotNull(), F.coalesce(c / F.lit(dt), zero))
            for a, c in zip("xyz", vector)
        }
    ).drop("_b", "_r", "_w")


def acceleration(
    df: DataFrame, speed: str, dt: float, keys: Sequence[str] = ("episode",), order: str = "frame_idx"
) -> DataFrame:
    """Change of the speed magnitude per second; 0 where it is unknown."""
    out = S.scan(df, keys, order, [S.lag("_p", speed)])
    return out.withColumn("acc", (F.col(speed) - F.col("_p")) / F.lit(dt)).drop("_p")


def jerk(df: DataFrame, keys: Sequence[str], order: str = "frame_idx") -> DataFrame:
    """Mean norm of the third difference over the rows given, times 1000; null below 4 rows.

    Gaps are closed up: pass valid rows only.
    """
    xs = ("x", "y", "z")
    out = df
    for level in range(3):
        now = xs if level == 0 else tuple(f"_d{level}_{c}" for c in xs)
        out = S.scan(out, keys, order, [S.lag("_b", F.struct(*now))])
        out = out.withColumns({f"_d{level + 1}_{c}": F.col(n) - F.col(f"_b.{n}") for c, n in zip(xs, now)}).drop("_b")
    size = G.norm([F.col(f"_d3_{c}") for c in xs])
    return out.groupBy(*keys).agg((F.avg(size) * 1000).alias("jerk"))


def onsets(df: DataFrame, flag: str, keys: Sequence[str] = ("episode",), order: str = "frame_idx") -> DataFrame:
    """Number of changes from False to True."""
    out = S.scan(df, keys, order, [S.lag("_p", flag)])
    return out.groupBy(*keys).agg(F.count_if(F.col(flag) & ~F.col("_p")).alias("onsets"))


def geometry_report(df: DataFrame) -> DataFrame:
    """Path length, step and turn percentiles, span, label shares and first finished frame.

    Input per frame: pose ``T``, ``grasp``, ``is_finished``; the steps are between adjacent rows.
    """
    out = S.scan(df, ["episode"], "frame_idx", [S.lag("_b", "T")])
    x, y, z = G.translation("T")
    out = out.withColumns(
        {
            "step_m": G.norm(G.sub(G.translation("T"), G.translation("_b"))),
            "turn_deg": G.rotation_angle(G.rotation("_b"), G.rotation("T")),
            "x": x,
            "y": y,
            "z": z,
        }
    )
    base = out.groupBy("episode").agg(
        F.sum("step_m").alias("path_m"),
        F.max("step_m").alias("max_step_m"),
        F.max("turn_deg").alias("max_turn_deg"),
        *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in "xyz"],
        F.avg((F.col("grasp") > 0.5).cast("double")).alias("grasp_fraction"),
        F.avg((F.col("is_finished") > 0.5).cast("double")).alias("finished_fraction"),
        F.min(F.when(F.col("is_finished") > 0.5, F.col("frame_idx"))).alias("first_finished_frame"),
    )
    steps = exact_quantiles(out, ["episode"], "step_m", [0.95], ["p95_step_m"])
    turns = exact_quantiles(out, ["episode"], "turn_deg", [0.95], ["p95_turn_deg"])
    return base.join(steps, "episode", "left").join(turns, "episode", "left")


def future_points(df: DataFrame, horizon: int, step: int, order: str = "frame_idx") -> DataFrame:
    """Points of the next ``horizon`` frames at every ``step``, as one row per pair.

    An equality join on the shifted index; each row meets at most ``horizon / step + 1`` rows.
    """
    base = df.select("episode", F.col(order).alias("base_idx"), F.struct("*").alias("base"))
    want = base.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))))
    target = df.select("episode", F.col(order).alias("target_idx"), F.struct("*").alias("target"))
    return want.withColumn("target_idx", F.col("base_idx") + F.col("offset")).join(target, ["episode", "target_idx"])


def moved_points(df: DataFrame, window: int, threshold: float, order: str = "frame_idx") -> DataFrame:
    """Start of the trailing window of each frame and whether the point moved away from it."""
    start = F.greatest(F.lit(0), F.col(order) - window)
    base = df.select("episode", F.col(order).alias("base_idx"), start.alias("start_idx"), "x", "y")
    target = df.select("episode", F.col(order).alias("start_idx"), F.col("x").alias("px"), F.col("y").alias("py"))
    distance = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    return base.join(target, ["episode", "start_idx"]).select(
        "episode", "base_idx", "start_idx", distance.alias("motion"), (distance > threshold).alias("moved")
    )


def trail_pieces(df: DataFrame, window: int, step: int, order: str = "frame_idx") -> DataFrame:
    """Pieces of the trailing path of each frame: both end frames must be present."""
    base = df.select("episode", F.col(order).alias("base_idx")).where(F.col("base_idx") > 0)
    start = F.greatest(F.lit(0), F.col("base_idx") - window)
    pieces = base.withColumn("from_idx", F.explode(F.sequence(start, F.col("base_idx") - 1, F.lit(step).cast("long"))))
    pieces = pieces.withColumn("to_idx", F.least(F.col("from_idx") + step, F.col("base_idx")))
    at = lambda side: df.select(
        "episode", F.col(order).alias(f"{side}_idx"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y")
    )
    return pieces.join(at("from"), ["episode", "from_idx"]).join(at("to"), ["episode", "to_idx"])
