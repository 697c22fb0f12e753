"""Registered queries for objects, stereo hands, latching, images and sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.functions import imaging as P
from framestride.operators import latch as L
from framestride.operators import objects as O
from framestride.operators import sync as Y
from framestride.plans.registry import query
from framestride.plans.surrogate import FRAMES_SQL, frames, table

F0 = f"with {FRAMES_SQL}"
K9 = (700.0, 0.0, 320.0, 0.0, 700.0, 240.0, 0.0, 0.0, 1.0)


def lits(values):
    return [F.lit(float(v)) for v in values]


def r(c: str, n: int):
    return F.round(c, n).alias(c)


# --- object keypoints ----------------------------------------------------------------------------

PART_SQL = """with p as (select p_partkey as kpt, p_brand as obj, p_size / 50e0 - 0.5e0 as x,
  p_retailprice - floor(p_retailprice) as y, 2e0 + p_partkey % 3 as z from part)"""


def keypoints(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("set").alias("episode"), F.col("p_brand").alias("obj"), F.col("p_partkey").alias("kpt"),
        (F.col("p_size") / F.lit(50.0) - 0.5).alias("x"), (F.col("p_retailprice") - F.floor("p_retailprice")).alias("y"),
        (F.lit(2.0) + F.col("p_partkey") % 3).alias("z"),
    )


def views(spark, sf_dir, noise: float = 0.0):
    """Every keypoint seen by six cameras along x."""
    k = keypoints(spark, sf_dir)
    v = k.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    cam = [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("frame_idx") / F.lit(10.0), *lits((0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1))]
    u = 700 * (F.col("x") - F.col("frame_idx") / F.lit(10.0)) / F.col("z") + 320
    w = 700 * F.col("y") / F.col("z") + 240
    shake = ((F.col("kpt") * 7 + F.col("frame_idx") * 3) % 5 - 2) * noise
    return v.select(
        "episode", "obj", "kpt", "frame_idx", (u + shake).alias("u"), (w - shake).alias("v"),
        ((F.col("kpt") + F.col("frame_idx")) % 4 != 0).cast("int").alias("vis"), F.array(*lits(K9)).alias("k"),
        F.array(*cam).alias("c2w"), F.col("z").alias("depth"), F.lit(640).alias("w"), F.lit(2000).alias("h"),
    )


@query(
    "multi_view_triangulation",
    PART_SQL + """, n as (select kpt, count(*) as views from p, range(6) t(f) where (kpt + f) % 4 <> 0 group by kpt)
      select p.kpt, views, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from p join n using (kpt)""",
)
def multi_view_triangulation(spark, sf_dir):
    o = O.triangulate(views(spark, sf_dir))
    zero = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return o.select("kpt", "views", zero("x"), zero("y"), zero("z"))


@query(
    "robust_point_refinement",
    PART_SQL + " select kpt, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from p",
)
def robust_point_refinement(spark, sf_dir):
    start = keypoints(spark, sf_dir).withColumns({"x": F.col("x") + 0.01, "z": F.col("z") + 0.02})
    o = O.refine_points(views(spark, sf_dir), start)
    zero = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return o.select("kpt", zero("x"), zero("y"), zero("z"))


@query(
    "refinement_with_outliers",
    PART_SQL + " select kpt, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from p",
)
def refinement_with_outliers(spark, sf_dir):
    """The exact views, outliers of 80 pixels to both sides, and a camera that has the point behind it.

    The pulls of the two outliers cancel at the true point and the last camera only costs a constant, so the
    true point stays the minimum.
    """
    v = views(spark, sf_dir)
    first = v.where("frame_idx = 0")
    shifted = [first.withColumns({"frame_idx": F.lit(n), "u": F.col("u") + du, "vis": F.lit(1)}) for n, du in ((6, 80), (7, -80))]
    back = F.array(*lits((-1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1)))
    behind = first.withColumns({"frame_idx": F.lit(8), "vis": F.lit(1), "c2w": back})
    rows = v.union(shifted[0].select(v.columns)).union(shifted[1].select(v.columns)).union(behind.select(v.columns))
    start = keypoints(spark, sf_dir).withColumns({"x": F.col("x") + 0.01, "z": F.col("z") + 0.02})
    o = O.refine_points(rows, start)
    zero = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return o.select("kpt", zero("x"), zero("y"), zero("z"))


@query(
    "depth_lift",
    PART_SQL + """, v as (select p.*, f, 700 * (x - f / 10e0) / z + 320 as u, 700 * y / z + 240 as w from p, range(6) t(f)
        where (kpt + f) % 4 <> 0),
      ok as (select *, row_number() over (partition by kpt order by f) as rn from v
        where round_even(u, 0) >= 0 and round_even(u, 0) < 640 and round_even(w, 0) >= 0 and round_even(w, 0) < 2000 and z <= 3)
      select kpt, count(*) as used, round(median((u - 320) * z / 700), 5) as x, round(median((w - 240) * z / 700), 5) as y,
        round(median(z), 5) as z from ok where rn <= 3 group by kpt""",
)
def depth_lift(spark, sf_dir):
    o = O.lift_points(views(spark, sf_dir), 3)
    zero = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return o.select("kpt", "used", zero("x"), zero("y"), zero("z"))


@query(
    "object_centres",
    PART_SQL + """ select obj, count(*) as n, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(avg(z), 6) as cz,
      count(*) >= 3 as usable from p group by obj""",
)
def object_centres(spark, sf_dir):
    o = O.object_centres(keypoints(spark, sf_dir))
    return o.select("obj", "n", r("cx", 6), r("cy", 6), r("cz", 6), "usable")


@query(
    "object_scatter",
    PART_SQL + """ select obj, round(covar_pop(x, x) * count(*), 7) as sxx, round(covar_pop(x, y) * count(*), 7) as sxy,
      round(covar_pop(z, z) * count(*), 7) as szz from p group by obj""",
)
def object_scatter(spark, sf_dir):
    o = O.scatter(keypoints(spark, sf_dir))
    return o.select("obj", r("sxx", 7), (F.round("sxy", 7) + F.lit(0.0)).alias("sxy"), r("szz", 7))


@query("object_principal_frames")
def object_principal_frames(spark, sf_dir):
    pts = keypoints(spark, sf_dir)
    first = pts.groupBy("episode").agg(F.min("obj").alias("anchor_key"))
    rules = pts.select("obj").distinct().withColumn("rule", F.when(F.ascii(F.substring("obj", -1, 1)) % 2 == 0, "pca1").otherwise("pca2"))
    o = O.object_frames(pts, first, rules)
    return o.select("obj", "n", "rule", F.transform("T", lambda v: F.round(v, 5)).alias("T"))


@query(
    "view_sampling",
    F0 + """, l as (select *, n_frames - 1 as last from frames) select episode, frame_idx from l
      where frame_idx >= 2 and ((frame_idx - 2) % 7 = 0 or frame_idx = last)""",
)
def view_sampling(spark, sf_dir):
    return O.sample_views(frames(spark, sf_dir), 7, 2).select("episode", "frame_idx")


# --- stereo ---------------------------------------------------------------------------------------

BASELINE = (1, 0, 0, -0.064, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
K_STEREO = (700, 0, 540, 0, 700, 405, 0, 0, 1)


@query(
    "two_view_triangulation",
    F0 + """ select episode, frame_idx, round(x * 0.2e0 - 0.1e0, 6) as px, round(0.4e0 + (event_id % 50) / 100e0, 6) as pz,
      0e0 as epipolar, true as valid from frames""",
)
def two_view_triangulation(spark, sf_dir):
    f = frames(spark, sf_dir)
    px, py, pz = F.col("x") * 0.2 - 0.1, F.col("y") * 0.1 - 0.05, F.lit(0.4) + (F.col("event_id") % 50) / F.lit(100.0)
    pairs = f.select(
        "episode", "frame_idx", (700 * px / pz + 540).alias("lu"), (700 * py / pz + 405).alias("lv"),
        (700 * (px - 0.064) / pz + 540).alias("ru"), (700 * py / pz + 405).alias("rv"),
    )
    k, m = F.array(*lits(K_STEREO)), F.array(*lits(BASELINE))
    o = O.triangulate_pairs(pairs, k, k, m)
    return o.select(
        "episode", "frame_idx", (F.round("x", 6) + F.lit(0.0)).alias("px"), F.round("z", 6).alias("pz"),
        (F.round("epipolar_px", 5) + F.lit(0.0)).alias("epipolar"), "valid",
    )


# Two turned cameras on a head, a little further to the side in some recordings; raw axes look backwards and are flipped to image axes.
def _mount(turn: float, tilt: float, at: tuple) -> tuple:
    c, s, d, e = math.cos(turn), math.sin(turn), math.cos(tilt), math.sin(tilt)
    return (c, s * e, s * d, at[0], 0.0, d, -e, at[1], -s, c * e, c * d, at[2], 0.0, 0.0, 0.0, 1.0)


RIG = {"l": _mount(0.10, 0.0, (-0.032, 0.010, 0.020)), "r": _mount(-0.08, 0.02, (0.035, 0.012, 0.018))}
FLIP = (1, 0, 0, 0, -1, 0, 0, 0, -1)


def _in_camera(eye: str, axis: int) -> str:
    """SQL of an image-camera coordinate of the head point (hx, hy, hz)."""
    m, sign, shift = RIG[eye], FLIP[4 * axis], ("(episode % 3) * 0.001::double", "0", "0")
    return "(" + " + ".join(f"{sign} * ({m[4 * i + axis]!r})::double * ({c} - ({m[4 * i + 3]!r})::double - {shift[i]})" for i, c in enumerate(("hx", "hy", "hz"))) + ")"


@query(
    "head_mounted_triangulation",
    F0 + f""", h as (select *, x * 0.2e0 - 0.1e0 as hx, y * 0.1e0 - 0.05e0 as hy, -(0.4e0 + (event_id % 50) / 20e0) as hz from frames),
      c as (select *, {_in_camera("l", 2)} as zl, {_in_camera("r", 2)} as zr, event_id % 7 = 0 as shaken from h)
      select episode, frame_idx, case when not shaken then round(hx, 5) end as hx, case when not shaken then round(hy, 5) end as hy,
        case when not shaken then round(hz, 5) end as hz, case when not shaken then round(zl, 5) end as depth_left,
        case when not shaken then round(zr, 5) end as depth_right, not shaken and zl between 0.1 and 2 and zr between 0.1 and 2 as valid
      from c""",
)
def head_mounted_triangulation(spark, sf_dir):
    f = frames(spark, sf_dir)
    f = f.withColumns({
        "hx": F.col("x") * 0.2 - 0.1, "hy": F.col("y") * 0.1 - 0.05, "hz": -(F.lit(0.4) + (F.col("event_id") % 50) / F.lit(20.0)),
    })
    pixels = {}
    for eye in "lr":
        a, b, c = (F.expr(_in_camera(eye, i)) for i in range(3))
        pixels |= {f"{eye}u": 700 * a / c + 540, f"{eye}v": 700 * b / c + 405}
    shaken = F.col("event_id") % 7 == 0
    pixels["rv"] = pixels["rv"] + F.when(shaken, 25).otherwise(0)
    pairs = f.select("episode", "frame_idx", shaken.alias("shaken"), *[c.alias(n) for n, c in pixels.items()])
    k, basis = F.array(*lits(K_STEREO)), F.array(*lits(FLIP))
    mount = {e: F.array(*[v + (F.col("episode") % 3) * 0.001 if i == 3 else v for i, v in enumerate(lits(RIG[e]))]) for e in "lr"}
    o = O.triangulate_in_head(pairs, k, k, mount["l"], mount["r"], basis)
    exact = lambda c, name: F.when(~F.col("shaken"), F.round(c, 5) + F.lit(0.0)).alias(name)
    return o.select(
        "episode", "frame_idx", exact("x", "hx"), exact("y", "hy"), exact("z", "hz"), exact(F.get("left_xyz", F.lit(2)), "depth_left"),
        exact(F.get("right_xyz", F.lit(2)), "depth_right"), "valid",
    )


def eye_hands(spark, sf_dir):
    """A hand of 21 points per frame and eye; some frames have a second right-eye detection."""
    f = frames(spark, sf_dir)
    e = f.select("episode", "frame_idx", "event_id", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("eye"))
    e = e.withColumn("hand_id", F.explode(F.when((F.col("eye") == "right") & (F.col("event_id") % 5 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    shift = F.when(F.col("eye") == "right", 0.064).otherwise(0.0)
    i = F.col("event_id")

    def joint(j):
        x = F.floor(j / 4) * 0.02 - 0.04 + (i % 3) * 0.01
        y = (j % 4) * 0.02 + F.when(j == 0, 0.05).otherwise(0.0)
        z = F.lit(0.6)
        return F.array(
            700 * (x - shift) / z + 540, 700 * y / z + 405 + F.col("hand_id") * F.when(i % 10 == 0, 0.5).otherwise(5.0)
        )

    return e.select(
        "episode", "frame_idx", "event_id", "eye", "hand_id", F.lit("right").alias("side"),
        F.when((i + F.col("hand_id")) % 17 == 0, 0.4).otherwise(0.9).alias("score"),
        F.transform(F.sequence(F.lit(0), F.lit(20)), joint).alias("uv"),
    )


EYES = F0 + """, eyes as (select episode, frame_idx, event_id, 'left' as eye, 0 as hand_id from frames
  union all select episode, frame_idx, event_id, 'right', 0 from frames
  union all select episode, frame_idx, event_id, 'right', 1 from frames where event_id % 5 = 0),
  scored as (select *, case when (event_id + hand_id) % 17 = 0 then 0.4e0 else 0.9e0 end as score from eyes)"""


@query(
    "handedness_pairs",
    EYES + """ select episode, frame_idx, 0 as left_id, case when event_id % 5 = 0 and event_id % 17 = 0 then 1 else 0 end as right_id,
      true as matched, event_id % 5 = 0 as ambiguous from frames""",
)
def handedness_pairs(spark, sf_dir):
    o = O.handedness_pairs(eye_hands(spark, sf_dir))
    return o.select("episode", "frame_idx", "left_id", "right_id", "matched", "ambiguous")


@query(
    "stereo_candidates",
    EYES + """ select l.episode, l.frame_idx, l.hand_id as left_id, r.hand_id as right_id from scored l join scored r
      using (episode, frame_idx) where l.eye = 'left' and r.eye = 'right' and l.score >= 0.5 and r.score >= 0.5""",
)
def stereo_candidates(spark, sf_dir):
    return O.candidate_pairs(eye_hands(spark, sf_dir)).select("episode", "frame_idx", "left_id", "right_id")


@query(
    "stereo_unique_matches",
    EYES + """, c as (select l.episode, l.frame_idx, l.event_id, r.hand_id, r.hand_id * case when l.event_id % 10 = 0 then 0.5e0 else 5e0 end * 2 as cost
        from scored l join scored r using (episode, frame_idx) where l.eye = 'left' and r.eye = 'right' and l.score >= 0.5 and r.score >= 0.5),
      q as (select *, min(cost) over (partition by episode, frame_idx) as lo, count(*) over (partition by episode, frame_idx) as n,
              max(cost) over (partition by episode, frame_idx) as hi from c)
      select episode, frame_idx, hand_id as right_id, round(cost, 4) as cost_px, n = 1 or (cost = lo and cost + 2 < hi) as unique_match from q""",
)
def stereo_unique_matches(spark, sf_dir):
    k, m = F.array(*lits(K_STEREO)), F.array(*lits(BASELINE))
    pts = O.pair_points(O.candidate_pairs(eye_hands(spark, sf_dir)), k, m)
    o = O.unique_matches(pts)
    unique = F.coalesce(F.col("rejection") != "ambiguous_correspondence", F.lit(True))
    return o.select(
        "episode", "frame_idx", "right_id", (F.round("cost_px", 4) + F.lit(0.0)).alias("cost_px"), unique.alias("unique_match")
    )


@query(
    "detection_summary",
    EYES + """ select episode, count(distinct frame_idx) as frames, count(*) filter (eye = 'left') as left_detections,
      count(*) filter (eye = 'right') as right_detections, count(distinct frame_idx) as candidate_pairs,
      0e0 as left_no_hand_ratio from scored group by episode""",
)
def detection_summary(spark, sf_dir):
    h = eye_hands(spark, sf_dir)
    o = O.detection_summary(frames(spark, sf_dir), h, O.handedness_pairs(h))
    return o.select("episode", "frames", "left_detections", "right_detections", "candidate_pairs", "left_no_hand_ratio")


VAR_SQL = F0 + """, j as (select case when event_id % 2 = 0 then 'confirmed' else 'candidate' end as variant, event_id % 21 as joint,
  event_id % 3 <> 0 as valid, value as epi, value * 2 as disp, value / 3 as le, value / 4 as re from frames)"""


def variant_joints(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    return frames(spark, sf_dir).select(
        F.when(i % 2 == 0, "confirmed").otherwise("candidate").alias("variant"), (i % 21).alias("joint"),
        (i % 3 != 0).alias("valid"), v.alias("epipolar_px"), (v * 2).alias("disparity_px"),
        (v / 3).alias("left_error_px"), (v / 4).alias("right_error_px"),
    )


@query(
    "geometry_variant_diagnostics",
    VAR_SQL + """ select variant, count(*) as joints, round(avg(case when valid then 1e0 else 0e0 end), 8) as valid_ratio,
      round(median(epi), 6) as epipolar_median_px, round(median(disp), 6) as disparity_median_px,
      round(avg(le), 6) as left_mean_px, round(median(re), 6) as right_median_px from j group by variant""",
)
def geometry_variant_diagnostics(spark, sf_dir):
    o = O.variant_diagnostics(variant_joints(spark, sf_dir))
    return o.select(
        "variant", "joints", r("valid_ratio", 8), r("epipolar_median_px", 6), r("disparity_median_px", 6), r("left_mean_px", 6),
        r("right_median_px", 6),
    )


@query(
    "joint_reprojection_errors",
    VAR_SQL + " select variant, joint, round(avg(le), 6) as left_mean_px, round(avg(re), 6) as right_mean_px from j group by variant, joint",
)
def joint_reprojection_errors(spark, sf_dir):
    return O.joint_errors(variant_joints(spark, sf_dir)).select("variant", "joint", r("left_mean_px", 6), r("right_mean_px", 6))


REPRO_SQL = F0 + """, p as (select episode, frame_idx, event_id, j, (j * 0.1e0 + value / 1000) as x, j * 0.05e0 as y,
  1e0 + j * 0.1e0 - case when event_id % 7 = 0 then 1.15e0 else 0 end as z from frames, range(5) t(j)),
  q as (select *, case when z > 1e-6 then (700 * x + 320 * z) / z end as u, case when z > 1e-6 then (700 * y + 240 * z) / z end as v from p)"""


@query(
    "reprojection_summary",
    REPRO_SQL + """ select episode, frame_idx, count(*) as points, count(u) as in_front, round(avg(u), 5) as mean_u,
      round(avg(case when u is not null then sqrt((u - 400) ** 2 + (v - 260) ** 2) end), 5) as mean_error_px,
      round(quantile_cont(case when u is not null then sqrt((u - 400) ** 2 + (v - 260) ** 2) end, 0.95), 5) as p95_error_px
      from q group by episode, frame_idx""",
)
def reprojection_summary(spark, sf_dir):
    f = frames(spark, sf_dir)
    drop = F.when(F.col("event_id") % 7 == 0, 1.15).otherwise(0.0)
    pts = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda j: F.array(j * 0.1 + F.col("value") / 1000, j * 0.05, F.lit(1.0) + j * 0.1 - drop),
    )
    eye = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    f = f.select(
        "episode", "frame_idx", pts.alias("points"), F.array_repeat(F.array(F.lit(400.0), F.lit(260.0)), 5).alias("pixels"),
        F.array(*lits(eye)).alias("c2w"), F.array(*lits(K9)).alias("k"),
    )
    o = O.reprojection_summary(f)
    return o.select("episode", "frame_idx", "points", "in_front", r("mean_u", 5), r("mean_error_px", 5), r("p95_error_px", 5))


def _adapter(row: dict) -> dict:
    if row["event_id"] % 13 == 0:
        raise ValueError("no points")
    return {"points": [[row["x"], row["y"], 1.0]]}


@query(
    "reprojection_adapter",
    F0 + """ select episode, frame_idx, case when event_id % 13 = 0 then 'ValueError: no points' end as error,
      case when event_id % 13 <> 0 then 1 end as n from frames""",
)
def reprojection_adapter(spark, sf_dir):
    o = O.adapter_points(frames(spark, sf_dir), _adapter, ["event_id", "x", "y"])
    return o.select("episode", "frame_idx", "error", F.when(F.col("points").isNotNull(), F.size("points")).alias("n"))


# --- latching -----------------------------------------------------------------------------------------


def latch_inputs(spark, sf_dir):
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    left = F.col("side") == "left"
    h = f.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    grasp = F.when(left, i % 7 < 4).otherwise(F.col("grasp"))
    x = F.when(left, F.col("x") / 3).otherwise(F.col("x") / 2)
    pose = G.from_parts(G.rotation_z(F.radians("value")), [x, (i % 13) / F.lit(60.0), F.lit(0.0)])
    ok = F.when(left, i % 9 != 0).otherwise(i % 11 != 0)
    hands = h.select(
        "episode", F.col("frame_idx").alias("pos"), "side", grasp.alias("grasp"), F.when(ok, F.array(*pose)).alias("T")
    )
    base = f.where(F.col("frame_idx") == 0).select("episode")
    objs = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    eye = G.rotation_z(F.lit(0.0))
    objects = objs.select(
        "episode", F.format_string("obj%d", F.col("j") + 1).alias("obj"),
        F.array(*G.from_parts(eye, [F.col("j") / F.lit(10.0), F.col("j") / F.lit(70.0), F.lit(0.0)])).alias("T"),
    )
    anchors = base.withColumn("anchor_key", F.lit("obj1"))
    return hands, objects, anchors


@query("latch_bindings")
def latch_bindings(spark, sf_dir):
    o = L.bindings(*latch_inputs(spark, sf_dir))
    return o.select("episode", "side", "run", "obj", F.transform("lock", lambda v: F.round(v, 6)).alias("lock"))


@query("latch_propagation")
def latch_propagation(spark, sf_dir):
    o = L.propagate(*latch_inputs(spark, sf_dir))
    return o.select("episode", "pos", "obj", "is_dynamic", F.transform("T", lambda v: F.round(v, 6)).alias("T"))


@query("robot_latch_propagation")
def robot_latch_propagation(spark, sf_dir):
    hands, objects, anchors = latch_inputs(spark, sf_dir)
    o = L.propagate(hands, objects, anchors, disabled=["left"])
    return o.select("episode", "pos", "obj", "is_dynamic", F.transform("T", lambda v: F.round(v, 6)).alias("T"))


@query("online_latch")
def online_latch(spark, sf_dir):
    hands, objects, _ = latch_inputs(spark, sf_dir)
    o = L.online_latch(hands, objects)
    return o.select("episode", "pos", "side", "obj", F.transform("T", lambda v: F.round(v, 6)).alias("T"))


@query(
    "session_dimension_join",
    F0 + """ select f.episode, f.frame_idx, 'obj' || (j + 1) as obj from frames f, range(3) t(j)""",
)
def session_dimension_join(spark, sf_dir):
    _, objects, _ = latch_inputs(spark, sf_dir)
    return Y.attach_session(frames(spark, sf_dir).select("episode", "frame_idx"), objects).select("episode", "frame_idx", "obj")


# --- images ---------------------------------------------------------------------------------------------

LUMA_SQL = """with l as (select vec_id, list_transform(embedding,
    lambda v: cast(floor(greatest(0, least(255, 128 + cast(v as double) * 256))) as integer)) as p from embeddings),
  i as (select vec_id, p, unnest(range(64)) as i from l), u as (select *, p[i + 1] as v from i)"""


def luma(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    level = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.lit(128.0) + v * 256))).cast("int")
    return e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), level).alias("luma"), F.lit(8).alias("w"), F.lit(8).alias("h"))


@query(
    "image_statistics",
    LUMA_SQL + """,
     g as (select vec_id, v, p[i - i % 8 + case when i % 8 = 0 then 1 else i % 8 - 1 end + 1]
       + p[i - i % 8 + case when i % 8 = 7 then 6 else i % 8 + 1 end + 1]
       + p[i % 8 + 8 * case when i // 8 = 0 then 1 else i // 8 - 1 end + 1]
       + p[i % 8 + 8 * case when i // 8 = 7 then 6 else i // 8 + 1 end + 1] - 4 * v as lap from u),
     n as (select vec_id, v, count(*) / 64e0 as s from u group by vec_id, v),
     t as (select vec_id, -sum(s * log2(s)) as entropy from n group by vec_id)
     select g.vec_id, round(avg(v), 6) as brightness, round(stddev_pop(v), 6) as contrast, round(var_pop(lap), 6) as blur_laplacian,
       round(any_value(entropy), 6) as entropy, round(avg(case when v <= 8 then 1e0 else 0e0 end), 6) as underexposed_frac
     from g join t using (vec_id) group by g.vec_id""",
)
def image_statistics(spark, sf_dir):
    s = luma(spark, sf_dir).withColumn("s", P.statistics(F.col("luma"), F.col("w"), F.col("h")))
    return s.select("vec_id", *[F.round(f"s.{c}", n).alias(c) for c, n in (("brightness", 6), ("contrast", 6), ("blur_laplacian", 6), ("entropy", 6), ("underexposed_frac", 6))])


@query(
    "difference_hash",
    LUMA_SQL + """,
     cells as (select c, cast(floor(c * 8 / 9e0) as int) as a, cast(least(ceil((c + 1) * 8 / 9e0), 8) as int) - 1 as b,
       c * 8 / 9e0 as lo, (c + 1) * 8 / 9e0 as hi from range(9) t(c)),
     small as (select vec_id, y, c, round_even((p[8 * y + a + 1] * (least(hi, a + 1e0) - greatest(lo, a * 1e0))
       + case when b > a then p[8 * y + b + 1] * (least(hi, b + 1e0) - greatest(lo, b * 1e0)) else 0 end) / (64 / 72e0), 0) as v
       from l, range(8) r(y), cells),
     bits as (select vec_id, 8 * y + c - 1 as i, case when v > lag(v) over (partition by vec_id, y order by c) then 1 else 0 end as bit, c from small),
     digits as (select vec_id, i // 4 as d, sum(bit << cast(3 - i % 4 as int)) as h from bits where c > 0 group by all)
     select vec_id, string_agg(substr('0123456789abcdef', cast(h as int) + 1, 1), '' order by d) as dhash from digits group by vec_id""",
)
def difference_hash(spark, sf_dir):
    s = luma(spark, sf_dir)
    return s.select("vec_id", P.difference_hash(P.resize_area(F.col("luma"), F.col("w"), F.col("h"), 9, 8)).alias("dhash"))


@query("appearance_vectors")
def appearance_vectors(spark, sf_dir):
    s = luma(spark, sf_dir)
    hue = F.transform("luma", lambda v: v % 180)
    small = P.resize_area(F.col("luma"), F.col("w"), F.col("h"), 8, 8)
    return s.select("vec_id", F.transform(P.appearance(small, hue, F.col("luma"), F.col("luma")), lambda v: F.round(v, 6)).alias("appearance"))


@query(
    "mask_coverage",
    LUMA_SQL + """ select vec_id, round(avg(case when v > 127 then 1e0 else 0e0 end), 8) as coverage,
      round(avg(case when v > 127 then 1e0 else 0e0 end) / 2, 8) as mean_coverage from u group by vec_id""",
)
def mask_coverage(spark, sf_dir):
    s = luma(spark, sf_dir).withColumn("coverage", P.coverage(F.col("luma")))
    both = P.object_coverage(F.array(F.col("coverage"), F.lit(0.0), F.lit(None)))
    return s.select("vec_id", r("coverage", 8), F.round(both["mean_coverage"], 8).alias("mean_coverage"))


# --- sampling --------------------------------------------------------------------------------------------


@query(
    "even_sample",
    F0 + """, s as (select episode, n_frames, cast(j as integer) as sample, cast(floor(j * (n_frames - 1) / 11e0) as bigint) as frame_idx
      from frames, range(12) t(j) where frames.frame_idx = 0) select episode, sample, frame_idx from s""",
)
def even_sample(spark, sf_dir):
    o = O.even_sample(frames(spark, sf_dir), 12, ["episode"], "frame_idx")
    return o.select("episode", "sample", "frame_idx")


@query(
    "contour_samples",
    F0 + """, c as (select episode, frame_idx as i, n_frames as n, round(100 * cos(2 * pi() * frame_idx / n_frames)) as x,
        round(100 * sin(2 * pi() * frame_idx / n_frames)) as y from frames),
      t as (select episode, first(i order by y, x, i) as top from c group by episode),
      q as (select c.*, (i - top + n) % n as q from c join t using (episode)),
      d as (select *, coalesce(lead(x) over w, first_value(x) over w) as tx, coalesce(lead(y) over w, first_value(y) over w) as ty
            from q window w as (partition by episode order by q)),
      l as (select *, sqrt((tx - x) ** 2 + (ty - y) ** 2) as len from d),
      e as (select *, sum(len) over (partition by episode order by q) as ed, sum(len) over (partition by episode) as total from l),
      b as (select *, coalesce(lag(ed) over (partition by episode order by q), 0) as bg from e),
      s as (select b.*, j, j * (total / 10) as t from b, range(10) r(j)
            where (j > floor(bg / (total / 10)) and j <= floor(ed / (total / 10))) or (j = 0 and q = 0))
      select episode, j as sample, cast(round_even(x + case when len > 0 then (t - bg) / len else 0 end * (tx - x), 0) as integer) as x,
        cast(round_even(y + case when len > 0 then (t - bg) / len else 0 end * (ty - y), 0) as integer) as y from s""",
)
def contour_samples(spark, sf_dir):
    f = frames(spark, sf_dir)
    a = 2 * F.pi() * F.col("frame_idx") / F.col("n_frames")
    c = f.select(
        "episode", F.lit("o").alias("obj"), F.col("frame_idx").alias("i"), F.round(100 * F.cos(a)).alias("x"),
        F.round(100 * F.sin(a)).alias("y"),
    )
    return O.contour_samples(c, 10).select("episode", "sample", "x", "y")


@query(
    "point_resampling",
    "select vec_id, 64 as n from embeddings",
)
def point_resampling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pts = F.transform(F.slice("embedding", 1, (F.col("vec_id") % 30 + 1).cast("int")), lambda v: F.array(v.cast("double"), F.lit(0.0), F.lit(1.0)))
    return e.select("vec_id", F.size(O.resample_points(pts)).alias("n"))
