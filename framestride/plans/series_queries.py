"""Registered queries for synchronisation, segments, phases and kinematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import islands as I
from framestride.operators import kinematics as K
from framestride.operators import phases as P
from framestride.operators import sync as Y
from framestride.plans.registry import query
from framestride.plans.surrogate import FRAMES_SQL, frames

W = "partition by episode order by pos"
F0 = f"with {FRAMES_SQL}"


def seg(name: str, src: str, value: str, carry: tuple[str, ...] = ()) -> str:
    """Run-length columns for the oracle: s, e, len, pv and nv of the run of each row."""
    ends = "".join(f", first({c} order by pos) as {c}_s, last({c} order by pos) as {c}_e" for c in carry)
    more = "".join(f", u.{c}_s, u.{c}_e" for c in carry)
    return f""",
{name}_a as (select *, {value} as sv, lag({value}) over ({W}) as sp from {src}),
{name}_b as (select *, sum(case when sp is null or sp <> sv then 1 else 0 end) over ({W}) as sg from {name}_a),
{name}_c as (select episode, sg, min(pos) as s, max(pos) as e, count(*) as len, any_value(sv) as v{ends}
             from {name}_b group by episode, sg),
{name}_d as (select *, lag(v) over (partition by episode order by sg) as pv,
             lead(v) over (partition by episode order by sg) as nv from {name}_c),
{name} as (select f.* exclude (sv, sp, sg), u.s, u.e, u.len, u.v, u.pv, u.nv{more}
           from {name}_b f join {name}_d u using (episode, sg))"""


def out(name: str, src: str, column: str, value: str) -> str:
    """Next table of a chain: the run columns dropped, one column replaced."""
    return f""", {name} as (select * exclude (s, e, len, v, pv, nv) replace ({value} as {column}) from {src})"""


def med(name: str, src: str, column: str, k: int) -> str:
    b, a = k // 2, k - 1 - k // 2
    return f""",
{name}_m as (select *, list({column}) over ({W} rows between {b} preceding and {a} following) as wl,
             count(*) over ({W} rows between {b} preceding and 1 preceding) as wn from {src}),
{name} as (select * exclude (wl, wn) replace (cast(list_sort(list_concat(list_concat(
             list_transform(range({b} - wn), lambda z: wl[1]), wl),
             list_transform(range({k} - ({b} - wn) - len(wl)), lambda z: wl[len(wl)])))[{k // 2 + 1}] as integer)
             as {column}) from {name}_m)"""


BASE = """,
base as (select episode, frame_idx, frame_idx as pos, event_id, value / 500 as v0, (event_id % 50) / 100e0 as w0,
         value < 40 as mask, cast(((frame_idx // 5) * 7 + episode + event_id % 2) % 3 as integer) as mode,
         frame_idx * 3e0 + event_id % 11 as yaw, case when event_id % 13 <> 0 then value / 300 end as hand_speed
         from frames)"""


def base(spark, sf_dir):
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    return f.select(
        "episode",
        "frame_idx",
        F.col("frame_idx").alias("pos"),
        "event_id",
        (F.col("value") / 500).alias("v"),
        ((i % 50) / F.lit(100.0)).alias("w"),
        (F.col("value") < 40).alias("mask"),
        ((F.floor(F.col("frame_idx") / 5) * 7 + F.col("episode") + i % 2) % 3).cast("int").alias("mode"),
        (F.col("frame_idx") * F.lit(3.0) + i % 11).alias("yaw_unwrapped_deg"),
        F.when(i % 13 != 0, F.col("value") / 300).alias("hand_speed"),
    )


# --- synchronisation ---------------------------------------------------------------------------

SYNC_SQL = f"""{F0},
video as (select episode, frame_idx, ts_us as ts from frames where event_id % 3 = 0),
track as (select episode, frame_idx as tracking_index, ts_us as tracking_ts from frames where event_id % 3 <> 0),
bwd as (select v.*, t.tracking_ts as bt, t.tracking_index as bi from video v asof left join track t
        on v.episode = t.episode and v.ts >= t.tracking_ts),
both_sides as (select v.*, t.tracking_ts as ft, t.tracking_index as fi from bwd v asof left join track t
        on v.episode = t.episode and v.ts <= t.tracking_ts),
matches as (select episode, frame_idx, ts,
   case when ft is null or ts - bt <= ft - ts then bt else ft end as tracking_ts,
   case when ft is null or ts - bt <= ft - ts then bi else fi end as tracking_index from both_sides),
synced as (select *, tracking_ts - ts as delta, coalesce(abs(tracking_ts - ts) <= 3600000000, false) as within_tolerance
   from matches)"""


def _matches(spark, sf_dir):
    f = frames(spark, sf_dir)
    video = f.where(F.col("event_id") % 3 == 0).select("episode", "frame_idx", F.col("ts_us").alias("ts"))
    track = f.where(F.col("event_id") % 3 != 0).select(
        "episode", F.col("frame_idx").alias("tracking_index"), F.col("ts_us").alias("tracking_ts")
    )
    return Y.synchronise(video, track, 3_600_000_000, payload=["tracking_index"])


@query("nearest_asof_sync", SYNC_SQL + " select * from synced")
def nearest_asof_sync(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(
    "sync_summary",
    SYNC_SQL + """ select episode, count(*) as video_frame_count, round(max(abs(delta)) / 1e3, 4) as sync_max_abs_ms,
      round(avg(abs(delta) / 1e3), 1) as sync_mean_abs_ms,
      round(avg(case when within_tolerance then 1e0 else 0e0 end), 6) as sync_within_tolerance_ratio,
      case when bool_and(within_tolerance) then 'PASS' else 'CHECK' end as status from synced group by episode""",
)
def sync_summary(spark, sf_dir):
    s = Y.sync_summary(_matches(spark, sf_dir), per_ms=1e3)
    return s.withColumns(
        {
            "sync_max_abs_ms": F.round("sync_max_abs_ms", 4),
            "sync_mean_abs_ms": F.round("sync_mean_abs_ms", 1),
            "sync_within_tolerance_ratio": F.round("sync_within_tolerance_ratio", 6),
        }
    )


@query(
    "sync_manifest",
    SYNC_SQL + """, kept as (select episode, frame_idx, row_number() over (partition by episode order by frame_idx) - 1
      as output_index from synced where within_tolerance)
      select s.episode, s.frame_idx, s.within_tolerance, k.output_index from synced s left join kept k
      using (episode, frame_idx)""",
)
def sync_manifest(spark, sf_dir):
    m = Y.manifest(_matches(spark, sf_dir))
    return m.select("episode", "frame_idx", "within_tolerance", "output_index")


@query(
    "frame_rates",
    f"""{F0}, d as (select *, ts_us - lag(ts_us) over (partition by episode order by frame_idx) as step from frames)
      select episode, case when count(*) >= 2 then floor((count(*) - 1) / ((max(ts_us) - min(ts_us)) * 1e-9) + 0.5)
        else 10e0 end as fps_duration, round(coalesce(1 / (median(step) * 1e-6), 30), 9) as fps_median
      from d group by episode""",
)
def frame_rates(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = Y.fps_from_duration(f, "ts_us", 1e-9).withColumnRenamed("fps", "fps_duration")
    b = Y.fps_from_median_step(f, "ts_us", 1e-6).select("episode", F.round("fps", 9).alias("fps_median"))
    return a.join(b, "episode")


@query(
    "monotonic_timestamp_guard",
    f"""{F0}, n as (select *, cast(floor(value) as bigint) + frame_idx // 3 as nominal from frames)
      select episode, frame_idx, max(nominal - frame_idx) over (partition by episode order by frame_idx) + frame_idx
        as guarded from n""",
)
def monotonic_timestamp_guard(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn(
        "nominal", F.floor("value").cast("long") + F.floor(F.col("frame_idx") / 3).cast("long")
    )
    return Y.monotonic_guard(f, "nominal").select("episode", "frame_idx", "guarded")


@query(
    "cache_coverage",
    f"""{F0} select episode, frame_idx, case when event_id % 5 = 0 then 'missing_in_cache'
          when event_id % 7 = 0 then 'time_differs' end as reason from frames
          where event_id % 5 = 0 or event_id % 7 = 0
        union all select episode, frame_idx + 1000000, 'unknown_frame' from frames where event_id % 11 = 0""",
)
def cache_coverage(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("pts_seconds", F.col("frame_idx") / F.lit(30.0))
    i = F.col("event_id")
    kept = f.where(i % 5 != 0).withColumn(
        "pts_seconds", F.when(i % 7 == 0, F.col("pts_seconds") + 0.5).otherwise(F.col("pts_seconds"))
    )
    extra = f.where(i % 11 == 0).withColumn("frame_idx", F.col("frame_idx") + 1000000)
    return Y.coverage_errors(f, kept.unionByName(extra))


# --- segments and masks ---------------------------------------------------------------------------

B = F0 + BASE


@query("run_length_segments", B + seg("g", "base", "mode") + " select distinct episode, s as start, e as \"end\", len, v as value from g")
def run_length_segments(spark, sf_dir):
    return I.segment_table(base(spark, sf_dir), "mode")


@query(
    "fill_short_gaps",
    B + seg("g", "base", "mask") + " select episode, frame_idx, v or (pv is not null and nv is not null and len <= 2) as mask from g",
)
def fill_short_gaps(spark, sf_dir):
    return I.fill_short_gaps(base(spark, sf_dir), "mask", 2).select("episode", "frame_idx", "mask")


@query("drop_short_runs", B + seg("g", "base", "mask") + " select episode, frame_idx, v and len > 2 as mask from g")
def drop_short_runs(spark, sf_dir):
    return I.drop_short_runs(base(spark, sf_dir), "mask", 2).select("episode", "frame_idx", "mask")


@query("median_filter", B + med("m", "base", "mode", 7) + " select episode, frame_idx, mode from m")
def median_filter(spark, sf_dir):
    return I.median_filter(base(spark, sf_dir), "mode", 7).select("episode", "frame_idx", "mode")


@query(
    "morphological_close",
    B + f""", d as (select *, max(mask) over ({W} rows between 4 preceding and 3 following) as m1 from base)
      select episode, frame_idx, min(m1) over ({W} rows between 4 preceding and 3 following) as mask from d""",
)
def morphological_close(spark, sf_dir):
    return I.close_mask(base(spark, sf_dir), "mask", 8).select("episode", "frame_idx", "mask")


@query(
    "merge_short_runs",
    B + seg("g", "base", "mode") + " select episode, frame_idx, case when len < 4 then coalesce(nv, pv, v) else v end as mode from g",
)
def merge_short_runs(spark, sf_dir):
    return I.merge_short_runs(base(spark, sf_dir), "mode", 4).select("episode", "frame_idx", "mode")


@query("delay_onset", B + seg("g", "base", "mask") + " select episode, frame_idx, v and pos >= s + 1 as mask from g")
def delay_onset(spark, sf_dir):
    return I.delay_onset(base(spark, sf_dir), "mask", 1).select("episode", "frame_idx", "mask")


@query(
    "longest_run",
    B + seg("g", "base", "(v0 > 0.1e0)") + """, r as (select episode, s, e, len, v, row_number() over
      (partition by episode order by v desc, len desc, s) as rn from (select distinct episode, s, e, len, v from g))
      select episode, case when v then s else -1 end as start, case when v then e else -1 end as "end" from r where rn = 1""",
)
def longest_run(spark, sf_dir):
    return I.longest_run(base(spark, sf_dir), F.col("v") > 0.1)


@query(
    "presence_runs",
    B + seg("g", "base", "(event_id % 4 <> 0)") + " select episode, frame_idx, v and len >= 3 as kept from g",
)
def presence_runs(spark, sf_dir):
    out = I.runs_of_presence(base(spark, sf_dir), F.col("event_id") % 4 != 0, 3, ["episode"])
    return out.select("episode", "frame_idx", "kept")


# --- phases ---------------------------------------------------------------------------------------

PC = P.PhaseConfig(
    v_stop=0.12, w_stop=0.4, hold=3, debounce=2, min_on=4, yaw_veto_deg=40.0, stop_offset=1, transition_offset=2,
    min_run=3, w_rotate=0.2, v_rotate_max=0.06, median=5, hesitation=8, wait=2, manual_offset=1, finished=3,
    hand_speed=0.17,
)

STOP_SQL = (
    B
    + ", st0 as (select *, v0 < 0.12e0 and w0 < 0.4e0 as stop from base)"
    + seg("st1", "st0", "stop")
    + out("st2", "st1", "stop", "v or (pv is not null and nv is not null and len <= 2)")
    + seg("st3", "st2", "stop")
    + out("st4", "st3", "stop", "v and len > 2")
)

SETTLE_SQL = (
    STOP_SQL
    + f", cl1 as (select *, max(stop) over ({W} rows between 1 preceding and 0 following) as m1 from st4)"
    + f", cl2 as (select * exclude (m1) replace (min(m1) over ({W} rows between 1 preceding and 0 following) as stop) from cl1)"
    + seg("se1", "cl2", "stop")
    + out("se2", "se1", "stop", "v and len > 3")
    + seg("se3", "se2", "stop", ("yaw",))
    + ", se4 as (select * exclude (s, e, len, v, pv, nv, yaw_s, yaw_e) replace (v and abs(yaw_e - yaw_s) < 40 as stop) from se3)"
    + seg("se5", "se4", "stop")
    + out("se6", "se5", "stop", "v and pos >= s + 1")
)

MODE_SQL = (
    SETTLE_SQL
    + ", mo0 as (select * replace (cast(case when stop then 0 when w0 >= 0.2e0 and v0 <= 0.12e0 then 2 else 1 end as integer) as mode) from se6)"
    + med("mo1", "mo0", "mode", 5)
    + seg("mo2", "mo1", "mode")
    + out("mo3", "mo2", "mode", "case when len < 3 then coalesce(nv, pv, v) else v end")
    + seg("mo4", "mo3", "mode")
    + ", mo5 as (select *, min(case when v <> 0 then s end) over (partition by episode) as fs from mo4)"
    + ", mo6 as (select * exclude (s, e, len, v, pv, nv, fs) replace (case when s = fs and v = 1 and nv = 2 and len < 8 then 2 else v end as mode) from mo5)"
    + seg("mo7", "mo6", "mode")
    + out("mo8", "mo7", "mode", "case when pv is not null and pos - s < least(2, len - 1) then pv else v end")
    + med("mo9", "mo8", "mode", 5)
    + seg("mo10", "mo9", "mode")
    + out("modes", "mo10", "mode", "case when len < 3 then coalesce(nv, pv, v) else v end")
)

FINISH_SQL = (
    MODE_SQL
    + seg("fi1", "modes", "mode")
    + ", fi2 as (select *, max(case when v <> 3 then e end) over (partition by episode) as fe from fi1)"
    + ", finished as (select * exclude (s, e, len, v, pv, nv, fe) replace (case when e = fe and pos > fe - 3 then 4 else v end as mode) from fi2)"
)


@query("stop_mask", STOP_SQL + " select episode, frame_idx, stop from st4")
def stop_mask(spark, sf_dir):
    return P.stop_mask(base(spark, sf_dir), PC).select("episode", "frame_idx", "stop")


@query("settled_stops", SETTLE_SQL + " select episode, frame_idx, stop from se6")
def settled_stops(spark, sf_dir):
    f = I.close_mask(P.stop_mask(base(spark, sf_dir), PC), "stop", PC.debounce)
    f = I.delay_onset(P.settle_stops(f, PC), "stop", PC.stop_offset)
    return f.select("episode", "frame_idx", "stop")


@query(
    "phase_modes",
    FINISH_SQL + """ select episode, frame_idx, mode, case mode when 0 then 'STOP' when 1 then 'FORWARD'
      when 2 then 'ROTATE' when 3 then 'TRANSITION' else 'FINISHED' end as mode_str from finished""",
)
def phase_modes(spark, sf_dir):
    return P.detect(base(spark, sf_dir), PC).select("episode", "frame_idx", "mode", "mode_str")


@query(
    "phase_counts",
    FINISH_SQL + """ select episode, count(*) filter (mode = 0) as stop_frames, count(*) filter (mode = 1) as forward_frames,
      count(*) filter (mode = 2) as rotate_frames, count(*) filter (mode = 3) as transition_frames,
      count(*) filter (mode = 4) as finished_frames, count(*) filter (mode in (1, 2)) as navigation_frames
      from finished group by episode""",
)
def phase_counts(spark, sf_dir):
    return P.mode_counts(P.detect(base(spark, sf_dir), PC))


@query(
    "phase_windows",
    B + seg("g", "base", "mode") + " select distinct episode, s as start, e as \"end\", len, v as mode from g",
)
def phase_windows(spark, sf_dir):
    return P.phase_windows(base(spark, sf_dir))


@query(
    "frames_in_phase_windows",
    B + " select episode, frame_idx from base where mode in (1, 2)",
)
def frames_in_phase_windows(spark, sf_dir):
    f = base(spark, sf_dir)
    return P.frames_in_windows(f, P.phase_windows(f), "navigation")


@query(
    "refined_phases",
    B + seg("g", "base", "mode") + f""",
    h as (select *, avg(coalesce(hand_speed, 99)) over ({W} rows between current row and 1 following) as ahead,
                 avg(coalesce(hand_speed, 99)) over ({W} rows between 1 preceding and current row) as behind from g),
    c as (select episode, s, min(case when pos - s < len - 2 and ahead < 0.17e0 then pos end) as cin,
                 max(case when pos - s >= 2 and behind < 0.17e0 then pos end) as cout from h group by episode, s)
    select episode, frame_idx, case when v = 0 and (
        (cin is null and pos - s < len - 2) or (pos < cin) or (pos >= cin and pos < cin + 1) or
        (cout is null and pos - s >= 2) or (pos > cout) or (pos <= cout and pos > cout - 1)) then 3 else v end as mode
    from h join c using (episode, s)""",
)
def refined_phases(spark, sf_dir):
    return P.refine_by_hand_speed(base(spark, sf_dir), PC).select("episode", "frame_idx", "mode")


@query(
    "reference_window",
    B + f""", r as (select *, min(case when mode = 0 then pos end) over (partition by episode) as f,
        count(*) filter (mode = 0) over ({W}) as seen from base),
      k as (select *, case when pos < f and pos >= f - least(f, 6) then pos - (f - least(f, 6))
              when mode = 0 and seen <= 4 - least(f, 6) then least(f, 6) + seen - 1 end as window_rank from r)
      select episode, frame_idx, window_rank from k where window_rank is not null""",
)
def reference_window(spark, sf_dir):
    return P.reference_window(base(spark, sf_dir), 6, 4).select("episode", "frame_idx", "window_rank")


# --- kinematics -------------------------------------------------------------------------------------

YAW_SQL = f"""{F0}, a as (select *, radians(value * 7 - 360 * floor((value * 7 + 180) / 360)) as yaw from frames),
 d as (select *, yaw - lag(yaw) over (partition by episode order by frame_idx) as dy from a),
 u as (select *, sum(case when dy is null then yaw when abs(dy) < pi() then dy
         else dy - 2 * pi() * floor((dy + pi()) / (2 * pi())) end)
         over (partition by episode order by frame_idx) as yaw_u from d)"""


def _yaw(spark, sf_dir):
    deg = F.col("value") * 7
    return frames(spark, sf_dir).withColumn("yaw", F.radians(deg - 360 * F.floor((deg + 180) / 360)))


@query("yaw_unwrap", YAW_SQL + " select episode, frame_idx, round(yaw_u, 6) as yaw_unwrapped from u")
def yaw_unwrap(spark, sf_dir):
    return K.unwrap(_yaw(spark, sf_dir), "yaw").select(
        "episode", "frame_idx", F.round("yaw_unwrapped", 6).alias("yaw_unwrapped")
    )


@query(
    "slam_rates",
    YAW_SQL + """ select episode, frame_idx,
      round(coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2) / 0.1e0, 0), 6) as v,
      round(coalesce(abs(yaw_u - lag(yaw_u) over w) / 0.1e0, 0), 5) as w
      from u window w as (partition by episode order by frame_idx)""",
)
def slam_rates(spark, sf_dir):
    o = K.slam_rates(_yaw(spark, sf_dir), 0.1)
    return o.select("episode", "frame_idx", F.round("v", 6).alias("v"), F.round("w", 5).alias("w"))


@query(
    "delta_from_first",
    f"""{F0} select episode, frame_idx, round(x - first_value(x) over w, 9) as delta_x,
        round(y - first_value(y) over w, 9) as delta_y from frames window w as (partition by episode order by frame_idx)""",
)
def delta_from_first(spark, sf_dir):
    o = K.from_first(frames(spark, sf_dir), ["x", "y"])
    return o.select("episode", "frame_idx", F.round("delta_x", 9).alias("delta_x"), F.round("delta_y", 9).alias("delta_y"))


@query(
    "wrapped_yaw_delta",
    f"""{F0}, d as (select episode, frame_idx, value * 7 - first_value(value * 7) over (partition by episode order by frame_idx) as d from frames)
        select episode, frame_idx, round(d - 360 * round(d / 360) + 0e0, 6) as delta_yaw_deg from d""",
)
def wrapped_yaw_delta(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("yaw", F.col("value") * 7)
    o = K.from_first(f, ["yaw"]).withColumn("w", K.wrapped_degrees(F.col("delta_yaw")))
    return o.select("episode", "frame_idx", (F.round("w", 6) + F.lit(0.0)).alias("delta_yaw_deg"))


def _poses(spark, sf_dir):
    f = frames(spark, sf_dir)
    pose = G.from_parts(G.rotation_z(F.radians("yaw_deg")), [F.col("x"), F.col("y"), F.col("z")])
    return f.withColumn("pos", F.col("frame_idx")).withColumn("T", F.when(F.col("yaw_deg").isNotNull(), F.array(*pose)))


@query(
    "head_rates",
    f"""{F0}, p as (select *, lag(frame_idx) over w as pf, lag(x) over w as px, lag(y) over w as py, lag(z) over w as pz,
          lag(value * 7) over w as pa, lag(ts_us) over w as pt from frames window w as (partition by episode order by frame_idx))
        select episode, frame_idx,
          round(coalesce(sqrt((x-px)**2 + (y-py)**2 + (z-pz)**2) / greatest((ts_us - pt) / 1e6, 1e-6), 0), 9) as linear_speed_mps,
          round(coalesce(acos(greatest(-1e0, least(1e0, cos(radians(value * 7 - pa))))) / greatest((ts_us - pt) / 1e6, 1e-6), 0), 6)
            as angular_speed_rps from p""",
)
def head_rates(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("ts_ns", F.col("ts_us") * 1000)
    pose = G.from_parts(G.rotation_z(F.radians(F.col("value") * 7)), [F.col("x"), F.col("y"), F.col("z")])
    o = K.head_rates(f.withColumn("T", F.array(*pose)), "T", "ts_ns")
    return o.select(
        "episode",
        "frame_idx",
        F.round("linear_speed_mps", 9).alias("linear_speed_mps"),
        F.round("angular_speed_rps", 6).alias("angular_speed_rps"),
    )


def _points(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select(
        "episode", F.lit("right").alias("side"), "frame_idx", F.col("frame_idx").alias("pos"), "ts_us", "event_id",
        *[F.when(F.col("yaw_deg").isNotNull(), F.col(c)).alias(c) for c in "xyz"],
    )


PTS_SQL = f"""{F0}, p as (select episode, frame_idx, ts_us, case when yaw_deg is not null then x end as x,
  case when yaw_deg is not null then y end as y from frames)"""


@query(
    "velocity_reset",
    PTS_SQL + """ select episode, frame_idx, case when x is null then null
       else round(coalesce((x - lag(x) over w) / 0.1e0, 0), 8) end as v_x from p window w as (partition by episode order by frame_idx)""",
)
def velocity_reset(spark, sf_dir):
    o = K.linear_velocity(_points(spark, sf_dir), ["x", "y", "z"], F.lit(0.1), "reset")
    return o.select("episode", "frame_idx", F.round("v_x", 8).alias("v_x"))


@query(
    "velocity_compact",
    PTS_SQL + """ select episode, frame_idx, round((x - last_value(x ignore nulls) over w) / 0.1e0, 8) as v_x
      from p window w as (partition by episode order by frame_idx rows between unbounded preceding and 1 preceding)""",
)
def velocity_compact(spark, sf_dir):
    o = K.linear_velocity(_points(spark, sf_dir), ["x", "y", "z"], F.lit(0.1), "compact")
    return o.select("episode", "frame_idx", F.round("v_x", 8).alias("v_x"))


@query(
    "velocity_measured",
    PTS_SQL + """ select episode, frame_idx, round(coalesce((x - lag(x) over w) /
      greatest((ts_us - lag(ts_us) over w) / 1e6, 1e-6), 0), 9) as v_x from p window w as (partition by episode order by frame_idx)""",
)
def velocity_measured(spark, sf_dir):
    o = K.measured_velocity(_points(spark, sf_dir).withColumn("ts_ns", F.col("ts_us") * 1000), ["x", "y", "z"], "ts_ns")
    return o.select("episode", "frame_idx", F.round("v_x", 9).alias("v_x"))


@query(
    "angular_velocity",
    f"""{F0}, p as (select *, radians(yaw_deg) - lag(radians(yaw_deg)) over (partition by episode order by frame_idx) as d from frames)
      select episode, frame_idx, case when yaw_deg is not null then
        round(coalesce((d - 2 * pi() * round(d / (2 * pi()))) / 0.1e0, 0), 5) end as w_z from p""",
)
def angular_velocity(spark, sf_dir):
    o = K.angular_velocity(_poses(spark, sf_dir).withColumn("side", F.lit("right")), "T", 0.1)
    return o.select("episode", "frame_idx", F.round("w_z", 5).alias("w_z"))


@query(
    "acceleration",
    f"""{F0} select episode, frame_idx, round((value - lag(value) over (partition by episode order by frame_idx)) / 0.1e0, 6)
        as acc from frames""",
)
def acceleration(spark, sf_dir):
    o = K.acceleration(frames(spark, sf_dir), "value", 0.1)
    return o.select("episode", "frame_idx", F.round("acc", 6).alias("acc"))


@query(
    "trajectory_jerk",
    f"""{F0}, v as (select * from frames where yaw_deg is not null),
      d as (select episode, x - 3 * lag(x, 1) over w + 3 * lag(x, 2) over w - lag(x, 3) over w as jx,
                   y - 3 * lag(y, 1) over w + 3 * lag(y, 2) over w - lag(y, 3) over w as jy,
                   z - 3 * lag(z, 1) over w + 3 * lag(z, 2) over w - lag(z, 3) over w as jz
            from v window w as (partition by episode order by frame_idx))
      select episode, round(avg(sqrt(jx * jx + jy * jy + jz * jz)) * 1000, 5) as jerk from d group by episode""",
)
def trajectory_jerk(spark, sf_dir):
    f = frames(spark, sf_dir).where("yaw_deg is not null")
    return K.jerk(f, ["episode"]).select("episode", F.round("jerk", 5).alias("jerk"))


@query(
    "grasp_onsets",
    f"""{F0}, p as (select *, lag(grasp) over (partition by episode order by frame_idx) as b from frames)
      select episode, count(*) filter (grasp and not b) as onsets from p group by episode""",
)
def grasp_onsets(spark, sf_dir):
    return K.onsets(frames(spark, sf_dir), "grasp")


@query(
    "geometry_report",
    f"""{F0}, p as (select *, case when yaw_deg is not null then x end as tx, case when yaw_deg is not null then y end as ty,
          case when yaw_deg is not null then z end as tz from frames),
      d as (select *, sqrt((tx - lag(tx) over w) ** 2 + (ty - lag(ty) over w) ** 2 + (tz - lag(tz) over w) ** 2) as st,
            abs(yaw_deg - lag(yaw_deg) over w) as ry from p window w as (partition by episode order by frame_idx)),
      t as (select *, case when ry is not null then degrees(acos(greatest(-1e0, least(1e0, cos(radians(ry)))))) end as tn from d)
      select episode, round(sum(st), 5) as path_m, round(max(st), 6) as max_step_m, round(quantile_cont(st, 0.95), 6) as p95_step_m,
        round(max(tn), 4) as max_turn_deg, round(quantile_cont(tn, 0.95), 4) as p95_turn_deg, round(max(tx) - min(tx), 6) as span_x,
        round(avg(case when grasp then 1e0 else 0e0 end), 6) as grasp_fraction,
        min(case when is_last and episode % 3 = 0 then frame_idx end) as first_finished_frame from t group by episode""",
)
def geometry_report(spark, sf_dir):
    f = _poses(spark, sf_dir).withColumn("grasp", F.col("grasp").cast("double")).withColumn(
        "is_finished", (F.col("is_last") & (F.col("episode") % 3 == 0)).cast("double")
    )
    r = lambda c, n: F.round(c, n).alias(c)
    return K.geometry_report(f).select(
        "episode", r("path_m", 5), r("max_step_m", 6), r("p95_step_m", 6), r("max_turn_deg", 4), r("p95_turn_deg", 4),
        r("span_x", 6), r("grasp_fraction", 6), "first_finished_frame",
    )


@query(
    "future_points",
    f"""{F0} select a.episode, a.frame_idx as base_idx, b.frame_idx as target_idx, round(b.x, 6) as x
      from frames a join frames b on a.episode = b.episode and b.frame_idx between a.frame_idx and a.frame_idx + 6
      and (b.frame_idx - a.frame_idx) % 2 = 0""",
)
def future_points(spark, sf_dir):
    o = K.future_points(frames(spark, sf_dir).select("episode", "frame_idx", "x"), 6, 2)
    return o.select("episode", "base_idx", "target_idx", F.round("target.x", 6).alias("x"))


@query(
    "trail_motion",
    f"""{F0} select a.episode, a.frame_idx as base_idx, b.frame_idx as start_idx,
      round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) as motion
      from frames a join frames b on a.episode = b.episode and b.frame_idx = greatest(0, a.frame_idx - 10)""",
)
def trail_motion(spark, sf_dir):
    o = K.moved_points(frames(spark, sf_dir), 10, 0.3)
    return o.select("episode", "base_idx", "start_idx", F.round("motion", 6).alias("motion"))


@query(
    "trail_pieces",
    f"""{F0}, k as (select * from frames where event_id % 9 <> 0),
      t as (select episode, frame_idx as base_idx, unnest(range(greatest(0, frame_idx - 10), frame_idx, 3)) as from_idx from k),
      q as (select *, least(from_idx + 3, base_idx) as to_idx from t)
      select q.episode, base_idx, from_idx, to_idx from q join k a on a.episode = q.episode and a.frame_idx = from_idx
      join k b on b.episode = q.episode and b.frame_idx = to_idx""",
)
def trail_pieces(spark, sf_dir):
    o = K.trail_pieces(frames(spark, sf_dir).where(F.col("event_id") % 9 != 0), 10, 3)
    return o.select("episode", "base_idx", "from_idx", "to_idx")
