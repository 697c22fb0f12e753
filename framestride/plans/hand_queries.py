"""Registered queries for hands, smoothing and the geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.functions import hands as H
from framestride.operators import folds
from framestride.operators import hands as O
from framestride.operators import smoothing as M
from framestride.operators.bounds import bound, with_bound
from framestride.plans.registry import query
from framestride.plans.series_queries import W, seg
from framestride.plans.surrogate import FRAMES_SQL, frames

F0 = f"with {FRAMES_SQL}"


def r(c: str, n: int):
    return F.round(c, n).alias(c)


def side(spark, sf_dir):
    """One hand per recording: distance and opening ratio are missing in some frames."""
    i = F.col("event_id")
    return frames(spark, sf_dir).select(
        "episode",
        F.lit("right").alias("side"),
        "frame_idx",
        F.col("frame_idx").alias("pos"),
        "event_id",
        "ts_us",
        "value",
        "grasp",
        F.when(i % 3 != 0, F.col("value") / 100).alias("d"),
        F.when(i % 13 != 0, F.lit(0.5) + (i % 100) / F.lit(100.0)).alias("ratio"),
        ((i % 100) / F.lit(100.0)).alias("confidence"),
    )


SIDE = F0 + """, side as (select *, frame_idx as pos, case when event_id % 3 <> 0 then value / 100 end as d,
  case when event_id % 13 <> 0 then 0.5e0 + (event_id % 100) / 100e0 end as ratio,
  (event_id % 100) / 100e0 as confidence from frames),
 nb as (select *, last_value(case when d is not null then pos end ignore nulls) over pw as bp,
   last_value(d ignore nulls) over pw as bd,
   first_value(case when d is not null then pos end ignore nulls) over nw as np,
   first_value(d ignore nulls) over nw as nd from side
   window pw as (partition by episode order by pos rows between unbounded preceding and 1 preceding),
          nw as (partition by episode order by pos rows between 1 following and unbounded following))"""
FILLED = SIDE + """, filled as (select * exclude (d), case when d is not null then d
   when bp is null then nd when np is null then bd
   else (1 - (pos - bp) / ((np - bp) * 1e0)) * bd + (pos - bp) / ((np - bp) * 1e0) * nd end as d from nb)"""


@query(
    "confidence_filter",
    SIDE + """ select episode, frame_idx, case when confidence >= case when episode % 2 = 0 then 0.25e0 else 0.5e0 end
      then d end as d from side""",
)
def confidence_filter(spark, sf_dir):
    s = side(spark, sf_dir).withColumn("method", F.when(F.col("episode") % 2 == 0, "image").otherwise("native"))
    return O.filter_confidence(s, ["d"], 0.5, ["image"]).select("episode", "frame_idx", "d")


@query(
    "auto_hand_selection",
    SIDE + """, t as (select episode, sum(case when event_id % 2 = 0 then confidence else 0 end) as rs,
      sum(case when event_id % 2 = 1 then confidence else 0 end) as ls from side group by episode)
      select episode, round(rs, 6) as right_score, round(ls, 6) as left_score,
        case when round(rs, 9) >= round(ls, 9) then 'right' else 'left' end as side from t""",
)
def auto_hand_selection(spark, sf_dir):
    s = side(spark, sf_dir).withColumn("side", F.when(F.col("event_id") % 2 == 0, "right").otherwise("left"))
    return O.selected_side(s).select("episode", r("right_score", 6), r("left_score", 6), "side")


@query(
    "short_gap_fill",
    SIDE + """ select episode, frame_idx, round(case when d is not null then d when np - bp - 1 <= 2 then
      (1 - (pos - bp) / ((np - bp) * 1e0)) * bd + (pos - bp) / ((np - bp) * 1e0) * nd end, 8) as d from nb""",
)
def short_gap_fill(spark, sf_dir):
    return M.fill_gaps(side(spark, sf_dir), ["d"], 2).select("episode", "frame_idx", r("d", 8))


@query(
    "pose_gap_interpolation",
    F0 + """, p as (select *, frame_idx as pos, case when event_id % 5 <> 0 then (event_id % 100) * 1.5e0 end as a from frames),
     nb as (select *, last_value(case when a is not null then pos end ignore nulls) over pw as bp,
       last_value(a ignore nulls) over pw as ba, first_value(case when a is not null then pos end ignore nulls) over nw as np,
       first_value(a ignore nulls) over nw as na from p
       window pw as (partition by episode order by pos rows between unbounded preceding and 1 preceding),
              nw as (partition by episode order by pos rows between 1 following and unbounded following))
     select episode, frame_idx, round(case when a is not null then a when np - bp - 1 <= 3 then
       ba + (na - ba) * (pos - bp) / ((np - bp) * 1e0) end, 4) as angle from nb""",
)
def pose_gap_interpolation(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = F.when(F.col("event_id") % 5 != 0, F.radians((F.col("event_id") % 100) * 1.5))
    pose = G.from_parts(G.rotation_z(a), [F.col("x"), F.col("y"), F.col("z")])
    f = f.withColumn("pos", F.col("frame_idx")).withColumn("T", F.when(a.isNotNull(), F.array(*pose)))
    out = M.fill_gaps(f, [], 3, ["episode"], poses=["T"])
    rot = G.rotation("T")
    return out.select("episode", "frame_idx", F.round(F.degrees(F.atan2(rot[3], rot[0])), 4).alias("angle"))


BOX = FILLED + f""", padded as (select *, first_value(d) over ({W} rows between unbounded preceding and unbounded following) as d0,
   last_value(d) over ({W} rows between unbounded preceding and unbounded following) as d1,
   sum(d) over ({W} rows between 2 preceding and 2 following) as sm,
   count(*) over ({W} rows between 2 preceding and current row) - 1 as l,
   count(*) over ({W} rows between current row and 2 following) - 1 as rr from filled),
 boxed as (select *, (sm + (2 - l) * d0 + (2 - rr) * d1) / 5 as bx from padded)"""


@query("interpolated_box_smoothing", BOX + " select episode, frame_idx, round(bx, 8) as d from boxed")
def interpolated_box_smoothing(spark, sf_dir):
    return M.interpolate_and_smooth(side(spark, sf_dir), "d", 5).select("episode", "frame_idx", r("d", 8))


@query(
    "grasp_from_tip_distance",
    BOX + ", g0 as (select *, round(bx, 12) < 0.15e0 as st from boxed)" + seg("g1", "g0", "st") + """,
    runs as (select distinct episode, s, len, pv, nv from g1),
    ranked as (select *, not (len <= 2 and pv is not null and nv is not null) as keep,
       row_number() over (partition by episode order by s) as rn from runs),
    streak as (select *, rn - coalesce(max(case when keep then rn end) over (partition by episode order by s), 0) as k from ranked)
    select episode, frame_idx, case when event_id % 3 <> 0 then cast(case when not keep and k % 2 = 1 then g1.pv else v end as integer) end
      as grasp_state from g1 join streak using (episode, s)""",
)
def grasp_from_tip_distance(spark, sf_dir):
    o = M.grasp_from_distance(side(spark, sf_dir).withColumn("side", F.lit("right")), "d", 0.15, 5, 2)
    return o.select("episode", "frame_idx", "grasp_state")


@query("savitzky_golay_smoothing")
def savitzky_golay_smoothing(spark, sf_dir):
    s = side(spark, sf_dir)
    out = M.savitzky_golay(s, ["value"], 21, 2, keys=["episode", "side"], pos="pos")
    return out.select("episode", "frame_idx", r("value", 6))


SG = M._savgol_weights(7, 2)[3]


@query(
    "savitzky_golay_interior",
    F0 + """, c as (select *, """ + " + ".join(
        f"{float(w)!r} * {f'lag(value, {3 - i})' if i < 3 else ('value' if i == 3 else f'lead(value, {i - 3})')}"
        + (f" over w" if i != 3 else "")
        for i, w in enumerate(SG)
    ) + """ as s from frames window w as (partition by episode order by frame_idx))
      select episode, frame_idx, round(s, 5) as value from c where s is not null""",
)
def savitzky_golay_interior(spark, sf_dir):
    s = frames(spark, sf_dir).withColumn("pos", F.col("frame_idx"))
    out = M.savitzky_golay(s, ["value"], 7, 2, keys=["episode"], pos="pos")
    inner = (F.col("pos") >= 3) & (F.col("pos") < F.col("n_frames") - 3)
    return out.where(inner).select("episode", "frame_idx", r("value", 5))


def _ema_sql(name: str, first: str, step: str) -> str:
    """A directed average of ``d``: a recursion over the positions."""
    return f"""{name}(episode, pos, s) as (
      select episode, pos, d from n where {first}
      union all
      select n.episode, n.pos, case when n.d is not null then coalesce(0.55e0 * n.d + 0.45e0 * p.s, n.d) end
      from {name} p join n on n.episode = p.episode and n.pos = p.pos {step} 1)"""


@query(
    "symmetric_ema",
    SIDE.replace("with", "with recursive", 1)
    + f""", n as (select episode, pos, d, max(pos) over (partition by episode) as top from side),
     {_ema_sql("fwd", "pos = 0", "+")}, {_ema_sql("bwd", "pos = top", "-")}
     select f.episode, f.pos as frame_idx, round((f.s + b.s) / 2 + 1e-9, 6) as d from fwd f join bwd b using (episode, pos)""",
)
def symmetric_ema(spark, sf_dir):
    out = folds.symmetric_ema(side(spark, sf_dir), ["d"], 0.55)
    # The averages have few decimals; the shift keeps both roundings away from ties.
    return out.select("episode", "frame_idx", F.round(F.col("d") + 1e-9, 6).alias("d"))


@query(
    "grasp_hysteresis",
    SIDE + """, kinds as (select episode, pos, case when ratio <= 0.9e0 then 1 when ratio >= 1.1e0 then 2 when ratio is not null then 3 end as kind from side),
     known as (select *, lag(pos) over w as bp, lag(kind) over w as bk from kinds where kind is not null window w as (partition by episode order by pos)),
     runs as (select *, sum(case when bk = kind and pos - bp - 1 <= 5 then 0 else 1 end) over (partition by episode order by pos) as run from known),
     events as (select episode, pos, case when kind = 1 then 1 else 0 end as state from (
       select *, row_number() over (partition by episode, run order by pos) as n from runs) where kind < 3 and n = 3)
     select k.episode, k.pos as frame_idx, coalesce(last_value(e.state ignore nulls) over (partition by k.episode order by k.pos), 0) as grasp_state
     from kinds k left join events e using (episode, pos)""",
)
def grasp_hysteresis(spark, sf_dir):
    out = folds.hysteresis(side(spark, sf_dir), "ratio")
    return out.select("episode", "frame_idx", "grasp_state")


def turning(spark, sf_dir):
    f = frames(spark, sf_dir)
    pose = G.from_parts(G.rotation_z(F.radians(F.col("value"))), [F.col("x"), F.col("y"), F.col("z")])
    ok = F.col("event_id") % 11 != 0
    return f.select(
        "episode", F.lit("right").alias("side"), "frame_idx", F.col("frame_idx").alias("pos"),
        F.when(ok, F.array(*pose)).alias("T"), F.when(ok, F.array(*G.rotation(pose))).alias("R"),
    )


@query("rotation_ema")
def rotation_ema(spark, sf_dir):
    out = folds.smooth_rotations(turning(spark, sf_dir), "R", 0.5)
    return out.select("episode", "frame_idx", F.transform("R", lambda v: F.round(v, 6)).alias("R"))


@query("axis_ema")
def axis_ema(spark, sf_dir):
    out = folds.smooth_axes(turning(spark, sf_dir), "R")
    return out.select("episode", "frame_idx", F.transform("R", lambda v: F.round(v, 6)).alias("R"))


@query("command_smoothing")
def command_smoothing(spark, sf_dir):
    out = folds.smooth_commands(turning(spark, sf_dir), "T")
    return out.select("episode", "frame_idx", F.transform("command", lambda v: F.round(v, 6)).alias("command"))


@query(
    "label_stats",
    SIDE + """, l as (select *, event_id % 3 <> 0 as observed, event_id % 6 <> 0 as final,
        cast(grasp as integer) as gs, lag(cast(grasp as integer)) over (partition by episode order by pos) as pg from side)
      select episode, count(*) filter (observed) as raw_frame_count, count(*) filter (final) as final_frame_count,
        count(*) filter (final and not observed) as interpolated_final_frame_count,
        count(*) filter (gs <> pg) as grasp_transition_count, round(quantile_cont(ratio, 0.05), 8) as opening_p5,
        round(quantile_cont(ratio, 0.5), 8) as opening_p50, round(quantile_cont(ratio, 0.95), 8) as opening_p95
      from l group by episode""",
)
def label_stats(spark, sf_dir):
    i = F.col("event_id")
    s = side(spark, sf_dir).withColumns(
        {"observed": i % 3 != 0, "final": i % 6 != 0, "grasp_state": F.col("grasp").cast("int")}
    )
    o = O.label_stats(s.withColumnRenamed("ratio", "opening_ratio"))
    return o.select(
        "episode", "raw_frame_count", "final_frame_count", "interpolated_final_frame_count", "grasp_transition_count",
        r("opening_p5", 8), r("opening_p50", 8), r("opening_p95", 8),
    )


METHODS_SQL = F0 + """,
 hd as (select episode, frame_idx, 'a' as method, true as valid, x, y, z, value as ang, grasp, (event_id % 100) / 100e0 as conf from frames
        where event_id % 7 <> 0
   union all select episode, frame_idx, 'b', true, x + (event_id % 10) / 1e3, y, z, value + event_id % 20, event_id % 4 <> 0,
        (event_id % 50) / 50e0 from frames where event_id % 9 <> 0),
 grid as (select f.episode, f.frame_idx, m.method, coalesce(h.valid, false) as valid, h.x, h.y, h.z, h.ang, h.grasp, h.conf
        from frames f cross join (values ('a'), ('b')) as m(method) left join hd h on h.episode = f.episode
        and h.frame_idx = f.frame_idx and h.method = m.method)"""


def _methods(spark, sf_dir):
    f = frames(spark, sf_dir)
    i = F.col("event_id")

    def hand(name, x, angle, grasp, conf, keep):
        pose = G.from_parts(G.rotation_z(F.radians(angle)), [x, F.col("y"), F.col("z")])
        return f.where(keep).select(
            "episode", "frame_idx", F.lit(name).alias("method"), F.array(*pose).alias("T"),
            grasp.cast("double").alias("grasp"), conf.alias("confidence"),
            (F.col("value") / 100).alias("v_x"), F.lit(0.0).alias("v_y"), F.lit(0.0).alias("v_z"),
        )

    a = hand("a", F.col("x"), F.col("value"), F.col("grasp"), (i % 100) / F.lit(100.0), i % 7 != 0)
    b = hand(
        "b", F.col("x") + (i % 10) / F.lit(1e3), F.col("value") + i % 20, i % 4 != 0, (i % 50) / F.lit(50.0), i % 9 != 0
    )
    return O.method_grid(f, a.unionByName(b), ["a", "b"])


@query("method_grid", METHODS_SQL + " select episode, frame_idx, method, valid from grid")
def method_grid(spark, sf_dir):
    return _methods(spark, sf_dir).select("episode", "frame_idx", "method", "valid")


@query(
    "method_comparison",
    METHODS_SQL + """, e as (select g.*, case when g.valid and q.valid then
        sqrt((g.x - q.x) ** 2 + (g.y - q.y) ** 2 + (g.z - q.z) ** 2) * 100 end as ate,
        case when g.valid and q.valid then degrees(acos(greatest(-1e0, least(1e0, cos(radians(g.ang - q.ang)))))) end as rot,
        case when g.valid and q.valid then case when g.grasp = q.grasp then 1e0 else 0e0 end end as ag
        from grid g join grid q on q.episode = g.episode and q.frame_idx = g.frame_idx and q.method = 'a')
      select episode, method, count(*) as n_frames, count(*) filter (valid) as n_detected,
        round(100e0 * count(*) filter (valid) / count(*), 1) as detection_rate, count(ate) as n_codetected,
        round(max(ate), 2) as ate_max_cm, round(median(ate), 2) as ate_median_cm, round(median(rot), 1) as rot_median_deg,
        round(100 * coalesce(avg(ag), 0), 1) as grasp_acc from e group by episode, method""",
)
def method_comparison(spark, sf_dir):
    o = O.compare_methods(_methods(spark, sf_dir), "a")
    return o.select(
        "episode", "method", "n_frames", "n_detected", "detection_rate", "n_codetected", "ate_max_cm", "ate_median_cm",
        "rot_median_deg", "grasp_acc",
    )


@query(
    "hand_kinematics_report",
    F0 + """, s as (select episode, unnest(['left', 'right']) as side, frame_idx, event_id, value, grasp from frames),
      p as (select *, case side when 'left' then event_id % 4 <> 0 else event_id % 7 <> 0 end as present,
              (case side when 'left' then not grasp else grasp end) as g from s),
      o as (select *, lag(g) over (partition by episode, side order by frame_idx) as pg from p)
      select episode, side, count(*) as total_frames, count(*) filter (present) as present_frames,
        round(max(value) filter (present), 6) as peak_lin_speed, round(avg(value) filter (present), 6) as mean_lin_speed,
        count(*) filter (g and not pg) as onsets from o group by episode, side""",
)
def hand_kinematics_report(spark, sf_dir):
    o = O.kinematics_report(_two_hands(spark, sf_dir))
    return o.select(
        "episode", "side", "total_frames", "present_frames", r("peak_lin_speed", 6), r("mean_lin_speed", 6), "onsets"
    )


def _two_hands(spark, sf_dir):
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    s = f.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    left = F.col("side") == "left"
    b = bound(f, ["episode"])
    s = with_bound(s, "episode", b * 2) if b is not None else s
    return s.select(
        "episode", "side", "frame_idx", F.when(left, i % 4 != 0).otherwise(i % 7 != 0).alias("present"),
        F.when(left, ~F.col("grasp")).otherwise(F.col("grasp")).alias("grasp"), F.col("value").alias("lin_speed"),
        (F.col("value") / 10).alias("ang_speed"),
    )


@query(
    "hand_presence_quality",
    F0 + """, p as (select episode, (count(*) filter (event_id % 4 <> 0) + count(*) filter (event_id % 7 <> 0)) /
        (2 * count(*) + 1e-6) as presence from frames group by episode)
      select episode, round(presence, 6) as presence, case when presence > 0.8 then 'EXCELLENT'
        when presence > 0.4 then 'GOOD' else 'PARTIAL' end as quality from p""",
)
def hand_presence_quality(spark, sf_dir):
    o = O.presence_quality(O.kinematics_report(_two_hands(spark, sf_dir)))
    return o.select("episode", r("presence", 6), "quality")


@query(
    "smoothing_deviation",
    F0 + """, d as (select episode, (event_id % 10) / 1e3 as e, (event_id % 20) * 1e0 as a from frames where event_id % 7 <> 0 and event_id % 9 <> 0)
      select episode, round(sqrt(avg(e * e)), 8) as pos_rmse, round(sqrt(avg(a * a)), 4) as rot_rmse from d group by episode""",
)
def smoothing_deviation(spark, sf_dir):
    g = _methods(spark, sf_dir)
    a = g.where("method = 'a'").select("episode", "frame_idx", F.col("T").alias("raw"))
    b = g.where("method = 'b'").select("episode", "frame_idx", F.col("T").alias("opt"))
    o = O.deviation_rmse(O.pose_deviation(a.join(b, ["episode", "frame_idx"])), ["episode"])
    return o.select("episode", r("pos_rmse", 8), r("rot_rmse", 4))


@query(
    "grasp_binarisation",
    F0 + """ select episode, frame_idx, cast(g > 0.5 as integer) as dataset, cast(g >= 0.5 as integer) as audit,
      cast(1 - g > 0.5 as integer) as gripper from (select *, (event_id % 11) / 10e0 as g from frames)""",
)
def grasp_binarisation(spark, sf_dir):
    g = (F.col("event_id") % 11) / F.lit(10.0)
    return frames(spark, sf_dir).select(
        "episode", "frame_idx", *[O.binarise_grasp(g, s).alias(s) for s in ("dataset", "audit", "gripper")]
    )


@query(
    "method_maps",
    F0 + """ select f.episode, f.frame_idx, m.method, case when m.method = 'b' and f.episode % 3 = 0 then null
      when m.method = 'a' then cast(f.event_id % 7 <> 0 as integer) else cast(f.event_id % 9 <> 0 as integer) end as n_hands
      from frames f cross join (values ('a'), ('b')) as m(method)""",
)
def method_maps(spark, sf_dir):
    f = frames(spark, sf_dir)
    h = _methods(spark, sf_dir).where("valid").withColumn("side", F.lit("right"))
    ran = f.select("episode", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("method")).distinct()
    ran = ran.where((F.col("method") == "a") | (F.col("episode") % 3 != 0))
    h = h.join(ran, ["episode", "method"], "left_semi")
    o = O.hands_by_method(f, h, ran)
    n = F.when(F.col("hands").isNotNull(), F.size("hands"))
    return o.select("episode", "frame_idx", "method", n.alias("n_hands"))


# --- geometry functions ---------------------------------------------------------------------------

def _quaternion_pose():
    q = [(F.col("event_id") % k - k // 2).cast("double") for k in (7, 11, 13, 17)]
    return G.pose7_to_pose([F.col("x"), F.col("y"), F.col("z"), *q])


@query(
    "quaternion_pose_roundtrip",
    F0 + """, q as (select *, event_id % 7 - 3e0 as a, event_id % 11 - 5e0 as b, event_id % 13 - 6e0 as c, event_id % 17 - 8e0 as d from frames),
      n as (select *, sqrt(a * a + b * b + c * c + d * d) as s from q)
      select episode, frame_idx, round(case when s < 1e-12 then 1 else 1 - 2 * (b * b + c * c) / (s * s) end, 8) as r00,
        round(case when s < 1e-12 then 0 else 2 * (a * b - c * d) / (s * s) end, 8) as r01,
        round(case when s < 1e-12 then 0 else 2 * (b * c + a * d) / (s * s) end, 8) as r21 from n""",
)
def quaternion_pose_roundtrip(spark, sf_dir):
    m = _quaternion_pose()
    return frames(spark, sf_dir).select(
        "episode", "frame_idx", F.round(m[0], 8).alias("r00"), F.round(m[1], 8).alias("r01"), F.round(m[9], 8).alias("r21")
    )


@query(
    "pose_inverse_composition",
    F0 + " select episode, frame_idx, 0e0 as error, 0e0 as affine_error from frames",
)
def pose_inverse_composition(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("T", F.array(*_quaternion_pose()))
    eye = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    f = f.withColumn("I", F.array(*G.inverse_rigid("T"))).withColumn("J", F.array(*G.inverse_affine("T")))
    gap = lambda m: F.round(G.norm([a - F.lit(float(e)) for a, e in zip(G.compose("T", m), eye)]), 6) + F.lit(0.0)
    return f.select("episode", "frame_idx", gap("I").alias("error"), gap("J").alias("affine_error"))


@query(
    "transformed_points",
    F0 + """, c as (select *, cos(radians(value)) as c, sin(radians(value)) as s from frames), p as (select *, unnest([0, 1, 2]) as i from c)
      select episode, frame_idx, i as point, round(c * (i + 1) - s * y + x, 6) as px, round(s * (i + 1) + c * y + y, 6) as py, round(i * 0.5e0 + z, 6) as pz from p""",
)
def transformed_points(spark, sf_dir):
    pose = G.from_parts(G.rotation_z(F.radians("value")), [F.col("x"), F.col("y"), F.col("z")])
    points = F.array(*[F.array(F.lit(i + 1.0), F.col("y"), F.lit(i * 0.5)) for i in range(3)])
    f = frames(spark, sf_dir).withColumn("T", F.array(*pose))
    f = f.select("episode", "frame_idx", F.posexplode(G.transform_points(points, F.col("T"))).alias("point", "p"))
    return f.select("episode", "frame_idx", "point", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{c}") for i, c in enumerate("xyz")])


@query(
    "registered_methods",
    F0 + " select method, count(*) as rows, round(avg(d), 6) as mean_d from (select 'a' as method, value / 100 as d from frames union all select 'b', y from frames where event_id % 2 = 0) group by method",
)
def registered_methods(spark, sf_dir):
    f = frames(spark, sf_dir)
    known = {
        "a": lambda: f.select("episode", "frame_idx", (F.col("value") / 100).alias("d")),
        "b": lambda: f.where("event_id % 2 = 0").select("episode", "frame_idx", F.col("y").alias("d")),
        "c": lambda: f.select("episode", "frame_idx", F.lit(0.0).alias("d")),
    }
    out = O.method_registry(known, ["a", "missing", "b"])
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("d"), 6).alias("mean_d"))


@query(
    "six_d_rotation",
    F0 + """ select episode, frame_idx, round(cos(radians(value * 7)) * 3 / (3 + 1e-8), 6) as e0,
      round(-sin(radians(value * 7)) * 3 / (3 + 1e-8), 6) as e1, round(sin(radians(value * 7)) * 3 / (3 + 1e-8), 6) as e2, 1e0 as r22 from frames""",
)
def six_d_rotation(spark, sf_dir):
    six = G.encode_6d(G.rotation_z(F.radians(F.col("value") * 7)))
    f = frames(spark, sf_dir).withColumn("six", F.array(*[v * 3 for v in six]))
    f = f.withColumn("R", F.array(*G.decode_6d("six"))).withColumn("n", F.array(*G.normalise_6d("six")))
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return f.select(
        "episode", "frame_idx", at("n", 0).alias("e0"), at("n", 1).alias("e1"), at("n", 2).alias("e2"), at("R", 8).alias("r22")
    )


@query(
    "euler_angles",
    F0 + """ select episode, frame_idx, round((event_id % 40) / 40e0, 6) as roll, round((event_id % 30) / 30e0, 6) as pitch,
      round((event_id % 50) / 25e0, 6) as yaw from frames""",
)
def euler_angles(spark, sf_dir):
    i = F.col("event_id")
    rx, ry, rz = (i % 40) / F.lit(40.0), (i % 30) / F.lit(30.0), (i % 50) / F.lit(25.0)
    f = frames(spark, sf_dir).withColumn("R", F.array(*G.euler_to_rotation(rx, ry, rz, "xyz")))
    rpy = G.roll_pitch_yaw("R")
    return f.select(
        "episode", "frame_idx", *[F.round(v, 6).alias(n) for v, n in zip(rpy, ("roll", "pitch", "yaw"))]
    )


@query(
    "rotation_log_and_slerp",
    F0 + """ select episode, frame_idx, round(radians((event_id % 340) * 0.5e0), 6) as w_z, round((event_id % 340) * 0.5e0 * 0.25e0, 5) as quarter_deg from frames""",
)
def rotation_log_and_slerp(spark, sf_dir):
    a = F.radians((F.col("event_id") % 340) * 0.5)
    eye = [F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    f = frames(spark, sf_dir).withColumn("R", F.array(*G.rotation_z(a))).withColumn("E", F.array(*eye))
    f = f.withColumn("w", G.log_map("R")).withColumn("S", G.slerp("E", "R", F.lit(0.25)))
    return f.select(
        "episode", "frame_idx", F.round(F.get("w", F.lit(2)), 6).alias("w_z"),
        F.round(F.degrees(F.atan2(F.get("S", F.lit(3)), F.get("S", F.lit(0)))), 5).alias("quarter_deg"),
    )


@query(
    "pinhole_projection_modes",
    F0 + """, c as (select *, x - 0.5e0 as px, y - 0.5e0 as py, z - 0.2e0 as pz from frames),
      u as (select *, (700 * px + 320 * pz) / pz as fu, (700 * px + 320 * pz) / (pz + 1e-6) as iu, (700 * py + 240 * pz) / (pz + 1e-6) as iv,
              700 * px / greatest(pz, 1e-6) + 320 as cu from c)
      select episode, frame_idx, pz > 1e-6 as front_ok, round(case when pz > 1e-6 then fu else 0 end, 6) as front_u,
        pz > 1e-3 and iu >= 0 and iu < 640 and iv >= 0 and iv < 480 as image_ok,
        round(case when pz < 1e-4 then 0.5e0 else greatest(0e0, least(1e0, fu / 640)) end, 12) as unit_u, round(cu, 5) as clamped_u from u""",
)
def pinhole_projection_modes(spark, sf_dir):
    k = [F.lit(float(v)) for v in (700, 0, 320, 0, 700, 240, 0, 0, 1)]
    p = [F.col("x") - 0.5, F.col("y") - 0.5, F.col("z") - 0.2]
    w, h = F.lit(640), F.lit(480)
    f = frames(spark, sf_dir).withColumns({m: G.project(p, k, m, w, h) for m in G.PROJECTION_MODES})
    return f.select(
        "episode", "frame_idx", F.col("front.valid").alias("front_ok"), F.round("front.u", 6).alias("front_u"),
        F.col("in_image.valid").alias("image_ok"), F.round("unit.u", 12).alias("unit_u"),
        F.round("clamped.u", 5).alias("clamped_u"),
    )


@query(
    "mirror_and_normalise",
    F0 + """ select episode, frame_idx, round(-x, 9) as mx, round(-(-sin(radians(value))), 8) as m01, 640e0 - 300 as cx,
      round((x - 0.1e0) / (0.2e0 + 1e-8), 6) as nx, round(x, 6) as back from frames""",
)
def mirror_and_normalise(spark, sf_dir):
    f = frames(spark, sf_dir)
    pose = G.from_parts(G.rotation_z(F.radians("value")), [F.col("x"), F.col("y"), F.col("z")])
    m = G.mirror_pose(pose)
    k = G.mirror_intrinsics([F.lit(float(v)) for v in (700, 0, 300, 0, 700, 240, 0, 0, 1)], F.lit(640.0))
    mean, std = [F.lit(0.1)] * 3, [F.lit(0.2)] * 3
    n = G.normalise_position([F.col("x"), F.col("y"), F.col("z")], mean, std)
    back = G.unnormalise_position(n, mean, std)
    return f.select(
        "episode", "frame_idx", F.round(m[3], 9).alias("mx"), F.round(m[1], 8).alias("m01"), k[2].alias("cx"),
        F.round(n[0], 6).alias("nx"), F.round(back[0], 6).alias("back"),
    )


def _skeleton(spark, sf_dir):
    """21 points per frame that depend on the frame's value."""
    f = frames(spark, sf_dir)
    i, v = F.col("event_id"), F.col("value")
    pts = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda j: F.array(
            F.sin(j * 1.3 + v) * 0.05, F.cos(j * 0.7 + i % 17) * 0.05, F.lit(0.4) + j / 200.0 + (i % 5) / 100.0
        ),
    )
    return f.select("episode", "frame_idx", "event_id", "value", pts.alias("pts"))


PT = """, pts as (select episode, frame_idx, event_id, value, list_transform(range(21), lambda j: [sin(j * 1.3e0 + value) * 0.05e0,
  cos(j * 0.7e0 + event_id % 17) * 0.05e0, 0.4e0 + j / 200e0 + (event_id % 5) / 100e0]) as p from frames)"""


@query(
    "hand_point_distances",
    F0 + PT + """ select episode, frame_idx, round(sqrt((p[1][1] - p[2][1]) ** 2 + (p[1][2] - p[2][2]) ** 2 + (p[1][3] - p[2][3]) ** 2), 8) as tip,
      round(sqrt((p[5][1] - p[9][1]) ** 2 + (p[5][2] - p[9][2]) ** 2 + (p[5][3] - p[9][3]) ** 2) /
            sqrt((p[6][1] - p[18][1]) ** 2 + (p[6][2] - p[18][2]) ** 2 + (p[6][3] - p[18][3]) ** 2), 6) as ratio,
      round((p[1][1] + p[6][1] + p[10][1]) / 3, 8) as palm_x from pts""",
)
def hand_point_distances(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    return s.select(
        "episode", "frame_idx", F.round(H.tip_distance(F.col("pts")), 8).alias("tip"),
        F.round(H.opening_ratio(F.col("pts")), 6).alias("ratio"),
        F.round(H.point(H.detector_to_skeleton(F.col("pts")), 20)[0], 8).alias("palm_x"),
    )


@query("hand_joint_angles")
def hand_joint_angles(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    return s.select("episode", "frame_idx", F.transform_values(H.joint_angles(F.col("pts")), lambda k, v: F.round(v, 4)).alias("angles"))


@query("gripper_frames")
def gripper_frames(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    p = lambda i: H.point("pts", i)
    s = s.withColumn("T", H.gripper_frame(p(0), p(2), p(5), p(4), p(8)))
    s = s.withColumn("R", H.gripper_rotation_or_null(p(0), p(2), p(5)))
    s = s.withColumn("segments", H.gripper_segments("T", F.col("value") < 40, 0.01, 0.08, 0.05, 0.04))
    return s.select(
        "episode", "frame_idx", F.transform("T", lambda v: F.round(v, 6)).alias("T"), F.col("R").isNotNull().alias("usable"),
        F.size("segments").alias("n_segments"),
    )


@query(
    "previous_axis_frames",
    f"""with recursive {FRAMES_SQL}, q as (select episode, frame_idx, event_id % 11 = 0 as absent, event_id % 5 = 0 as degenerate,
        cos(radians(floor(value) * 40)) as c, sin(radians(floor(value) * 40)) as s from frames),
      walk as (select episode, -1::bigint as frame_idx, null::double as c, null::double as s, null::double as sign, true as absent from q group by 1
        union all
        select q.episode, q.frame_idx,
          case when q.absent then w.c when q.degenerate then coalesce(w.c, 0) else q.c end,
          case when q.absent then w.s when q.degenerate then coalesce(w.s, 1) else q.s end,
          case when q.absent then w.sign when q.degenerate then coalesce(w.sign, 1)
            when w.sign * (w.c * q.c + w.s * q.s) < 0 then -1 else 1 end, q.absent
        from walk w join q on q.episode = w.episode and q.frame_idx = w.frame_idx + 1)
      select episode, frame_idx, case when not absent then round(sign * c, 6) + 0 end as xx, case when not absent then round(sign * s, 6) + 0 end as xy,
        case when not absent then round(sign * -s, 6) + 0 end as yx, case when not absent then 1e0 end as zz from walk where frame_idx >= 0""",
)
def previous_axis_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    turn = F.radians(F.floor("value") * 40)
    c, s, zero = F.cos(turn), F.sin(turn), F.lit(0.0)
    arm = F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(0.1)
    index = [c * 0.05, s * 0.05, zero]
    wrist = [index[0] / 2 + s * arm, index[1] / 2 - c * arm, zero]
    own = H.gripper_rotation_or_null(wrist, [zero] * 3, index)
    turned = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    rows = f.select("episode", "frame_idx", own.alias("R"), turned.alias("wrist"), (F.col("event_id") % 11 != 0).alias("seen"))
    o = O.keep_previous_axes(rows, "R", "wrist", F.col("seen"), ["episode"])
    at = lambda i, name: (F.round(F.get("R", F.lit(i)), 6) + 0.0).alias(name)
    return o.select("episode", "frame_idx", at(0, "xx"), at(3, "xy"), at(1, "yx"), at(8, "zz"))


@query("palm_frames")
def palm_frames(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    p = lambda i: H.point("pts", i)
    wrist, palm = H.wrist_and_palm(p(1), p(2), p(3), p(4))
    return s.select("episode", "frame_idx", F.transform(palm, lambda v: F.round(v, 6)).alias("palm"), wrist.isNotNull().alias("ok"))


@query("absolute_hand_points")
def absolute_hand_points(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    k = [F.lit(float(v)) for v in (700, 0, 320, 0, 700, 240, 0, 0, 1)]
    uv = F.transform("pts", lambda q: F.array(q[0] / q[2] * 700 + 320, q[1] / q[2] * 700 + 240))
    s = s.withColumn("uv", uv).withColumn("cam", H.absolute_points(F.col("uv"), F.col("pts"), k))
    conf = H.reprojection_confidence(F.col("pts"), F.col("uv"), k, F.lit(640), F.lit(480), 0.6)
    return s.select("episode", "frame_idx", F.round(H.point("cam", 0)[2], 5).alias("wrist_z"), F.round(conf, 5).alias("confidence"))


@query("hand_shape_gates")
def hand_shape_gates(spark, sf_dir):
    s = _skeleton(spark, sf_dir)
    valid = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: (j + F.col("event_id")) % 40 != 0)
    s = s.withColumn("ok", valid)
    status = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda j: F.when((j + F.col("event_id")) % 50 == 0, 0).otherwise(8))
    return s.select(
        "episode", "frame_idx", H.shape_valid(F.col("pts"), F.col("ok"), (0.0, 1.0), (0.0, 1.0)).alias("shape_ok"),
        H.frame_valid(F.col("pts"), F.col("ok"), 0.65, (0.0, 1.0)).alias("frame_ok"),
        H.status_confidence(status).alias("confidence"),
    )
