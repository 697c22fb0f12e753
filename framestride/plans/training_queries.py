"""Registered queries of the training table, with the latch as a recursion in the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.operators import training as T
from framestride.plans.object_queries import latch_inputs
from framestride.plans.registry import query
from framestride.plans.surrogate import FRAMES_SQL, frames
from framestride.sources import records as J

NEEDED = ["cameras", "hands", "phases", "slam"]


def inputs(spark, sf_dir):
    """Records of each kind, some missing, with the hands, objects and anchors of the latch queries."""
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    hands, objects, anchors = latch_inputs(spark, sf_dir)
    entry = F.struct("side", F.struct("T", F.col("grasp").cast("double").alias("grasp")))
    hands = hands.groupBy("episode", F.col("pos").alias("frame_idx")).agg(F.map_from_entries(F.collect_list(entry)).alias("hands"))
    kept = f.where(i % 29 != 0).select("episode", "frame_idx")
    k = F.array(*[F.lit(v) for v in (700.0, 0.0, 320.0, 0.0, 700.0, 240.0, 0.0, 0.0, 1.0)])
    pose = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])
    camera = f.where(i % 17 != 0).select("episode", "frame_idx", F.col("ts_us").alias("ts"), F.lit(640).alias("w"), F.lit(480).alias("h"), F.lit(30.0).alias("fps"), k.alias("k"), pose.alias("c2w"))
    tables = {
        "cameras": camera,
        "hands": hands.join(kept, ["episode", "frame_idx"]),
        "phases": f.where(i % 19 != 0).select("episode", "frame_idx", (i % 5).alias("mode")),
        "slam": f.where(i % 23 != 0).select("episode", "frame_idx", F.col("x").alias("linear_speed_mps")),
        "hands_other": hands.join(f.where(i % 3 == 0).select("episode", "frame_idx"), ["episode", "frame_idx"]),
    }
    return tables, objects, anchors


_HANDS_SQL = FRAMES_SQL + """,
hand as (
  select f.episode, f.frame_idx, f.event_id, case when event_id % 5 = 4 then 1e0 else 0e0 end as is_finished,
         row_number() over (partition by f.episode order by f.frame_idx) as t,
         event_id % 7 < 4 as l_g, event_id % 9 <> 0 as l_ok, grasp as r_g, event_id % 11 <> 0 as r_ok,
         radians(value) as ha, x / 3 as l_x, x / 2 as r_x, (event_id % 13) / 60e0 as hy
  from frames f where event_id % 17 <> 0 and event_id % 29 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0)"""


def _side(s: str, source: str) -> str:
    """SQL of one hand's step over the columns of ``source``: decide, bind, move."""
    dist = lambda o: f"sqrt(({s}_x - x{o})**2 + (hy - y{o})**2 + z{o}**2)"
    move = ", ".join(
        f"case when {s}_n = {o} and {s}_ok then ha + {s}_la else a{o} end as a{o}, "
        f"case when {s}_n = {o} and {s}_ok then {s}_x + cos(ha) * {s}_lx - sin(ha) * {s}_ly else x{o} end as x{o}, "
        f"case when {s}_n = {o} and {s}_ok then hy + sin(ha) * {s}_lx + cos(ha) * {s}_ly else y{o} end as y{o}, "
        f"case when {s}_n = {o} and {s}_ok then {s}_lz else z{o} end as z{o}"
        for o in (2, 3)
    )
    of = lambda v: f"case when {s}_n = 2 then {v}2 else {v}3 end"
    binds = f"{s}_binds and {s}_n > 0"
    return f"""(select * replace ({move}) from
    (select * replace (
       case when {binds} then {of("a")} - ha else {s}_la end as {s}_la,
       case when {binds} then cos(ha) * ({of("x")} - {s}_x) + sin(ha) * ({of("y")} - hy) else {s}_lx end as {s}_lx,
       case when {binds} then -sin(ha) * ({of("x")} - {s}_x) + cos(ha) * ({of("y")} - hy) else {s}_ly end as {s}_ly,
       case when {binds} then {of("z")} else {s}_lz end as {s}_lz) from
    (select * replace (
       {s}_binds or ({s}_on and {s}_g) as {s}_on,
       case when {s}_binds then case when least({dist(2)}, {dist(3)}) < 0.2e0 then case when {dist(2)} <= {dist(3)} then 2 else 3 end else 0 end
            when not {s}_g then 0 else {s}_n end as {s}_n) from
    (select * replace ({s}_free or not {s}_g as {s}_free, {s}_g and not {s}_on and ({s}_free or not {s}_g) and {s}_ok as {s}_binds) from {source}))))"""


_STATE = [f"{s}_{c}" for s in "lr" for c in ("on", "free", "binds", "n", "la", "lx", "ly", "lz")] + [f"{c}{o}" for o in (2, 3) for c in "axyz"]
_START = ", ".join(
    [f"false as {s}_{c}" for s in "lr" for c in ("on", "free", "binds")]
    + [f"0 as {s}_n" for s in "lr"] + [f"0e0 as {s}_{c}" for s in "lr" for c in ("la", "lx", "ly", "lz")]
    + ["0e0 as a2", "1e0 / 10 as x2", "1e0 / 70 as y2", "0e0 as z2", "0e0 as a3", "2e0 / 10 as x3", "2e0 / 70 as y3", "0e0 as z3"]
)

def latch_sql(hand: str) -> str:
    """The latch of both hands as a recursion over the frames of the table ``hand`` that the SQL defines."""
    return f"""with recursive {hand},
run as (
  select episode, cast(0 as bigint) as t, {", ".join(c for c in _STATE)} from (select distinct episode, {_START} from hand)
  union all
  select episode, t, {", ".join(_STATE)} from {_side("r", _side("l", f"(select hand.*, {', '.join('run.' + c for c in _STATE)} from run join hand on hand.episode = run.episode and hand.t = run.t + 1)"))})"""


LATCH_SQL = latch_sql(_HANDS_SQL)


@query(
    "training_table",
    LATCH_SQL + """, placed as (
      select episode, t, 'obj1' as obj, 0 as n, 0e0 as a, 0e0 as x, 0e0 as y, 0e0 as z, l_n, r_n from run
      union all select episode, t, 'obj2', 2, a2, x2, y2, z2, l_n, r_n from run
      union all select episode, t, 'obj3', 3, a3, x3, y3, z3, l_n, r_n from run)
    select episode, frame_idx, is_finished, cast(l_ok as integer) + cast(r_ok as integer) as n_hands,
      case when event_id % 3 = 0 then cast(l_ok as integer) + cast(r_ok as integer) end as n_other, obj,
      n > 0 and (l_n = n or r_n = n) as is_dynamic, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z,
      round(cos(a), 5) + 0e0 as c, round(sin(a), 5) + 0e0 as s
    from placed join hand using (episode, t)""",
)
def training_table(spark, sf_dir):
    rows = T.training_table(*inputs(spark, sf_dir))
    at = lambda k: F.round(F.col("o.T")[k], 5) + F.lit(0.0)
    seen = F.size(F.map_filter("hands_other", lambda _, h: h["T"].isNotNull()))
    rows = rows.select("episode", "frame_idx", "is_finished", F.size("hands").alias("n_hands"), F.when(F.col("hands_other").isNotNull(), seen).alias("n_other"), F.explode("objects").alias("obj", "o"))
    return rows.select("episode", "frame_idx", "is_finished", "n_hands", "n_other", "obj", "o.is_dynamic", at(3).alias("x"), at(7).alias("y"), at(11).alias("z"), at(0).alias("c"), at(4).alias("s"))


@query(
    "training_counters",
    f"""with {FRAMES_SQL} select episode, count(*) as total,
      count(*) filter (ok) as valid, count(*) filter (not ok) as discarded_missing_file, cast(0 as bigint) as discarded_no_hand
    from (select *, event_id % 17 <> 0 and event_id % 29 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 as ok from frames) group by episode""",
)
def training_counters(spark, sf_dir):
    tables, _, _ = inputs(spark, sf_dir)
    listed = frames(spark, sf_dir).select("episode", "frame_idx")
    return T.counters(T.presence({"listed": listed, **{t: tables[t] for t in NEEDED}}), NEEDED)


# --- robot sessions ------------------------------------------------------------------------------------

_ROBOT_SQL = FRAMES_SQL + """,
image as (select *, row_number() over (partition by episode order by frame_idx) as place, count(*) over (partition by episode) as listed
  from frames where event_id % 17 <> 0),
hand as (
  select f.episode, f.frame_idx, f.event_id, value, case when event_id % 5 = 4 or place > listed - 4 then 1e0 else 0e0 end as is_finished,
         row_number() over (partition by f.episode order by f.frame_idx) as t, f.episode % 2 = 0 as dual,
         f.episode % 2 = 0 and event_id % 7 < 4 as l_g, f.episode % 2 = 0 and event_id % 9 <> 0 as l_ok, grasp as r_g, event_id % 11 <> 0 as r_ok,
         radians(value) as ha, x / 3 as l_x, x / 2 as r_x, (event_id % 13) / 60e0 as hy
  from image f where event_id % 29 <> 0 and f.episode % 10 <> 3)"""


def robot_inputs(spark, sf_dir):
    """Sessions with two arms (even) or one (odd, or one in two layouts), some without metadata, states or images."""
    f = frames(spark, sf_dir)
    i, dual = F.col("event_id"), F.col("episode") % 2 == 0
    hands, objects, anchors = latch_inputs(spark, sf_dir)
    nested = F.when(F.col("T").isNotNull(), F.array(*[F.slice("T", 4 * j + 1, 4) for j in range(4)]))
    arm = F.struct(nested.alias("T_ee_in_cam"), F.when(F.col("grasp"), 0.25).otherwise(0.75).alias("gripper_q"))
    arms = hands.groupBy("episode", F.col("pos").alias("frame_idx")).agg(F.map_from_entries(F.collect_list(F.struct("side", arm))).alias("both"))
    rows = f.join(arms, ["episode", "frame_idx"]).where(i % 29 != 0)
    right = F.col("both")["right"]
    with_joints = F.transform_values("both", lambda _, a: F.struct(a["T_ee_in_cam"].alias("T_ee_in_cam"), a["gripper_q"].alias("gripper_q"), F.array("value").alias("joints")))
    common = [F.col("ts_us").cast("double").alias("ts"), (i % 5 == 4).alias("is_finished")]
    named = F.struct(*common, with_joints.alias("arms"))
    plain = F.struct(*common, right["T_ee_in_cam"].alias("T_ee_in_cam"), right["gripper_q"].alias("gripper_q"), F.array("value").alias("joints"))
    # Single-arm sessions come in the layout without arms, or name a left arm that takes no part.
    text = F.when(dual | (i % 2 == 0), F.to_json(named)).otherwise(F.to_json(plain))
    states = J.parse_records(rows.select("episode", "frame_idx", text.alias("value")), "robot")
    facts = f.where("frame_idx = 0 and episode % 10 <> 3").select("episode", F.to_json(F.struct(F.lit(1280).alias("w"), dual.alias("dual_arm"))).alias("value"))
    meta = J.session_meta(J.parse_records(facts, "session"))
    return states, f.where(i % 17 != 0), meta, objects, anchors


@query(
    "robot_training_table",
    latch_sql(_ROBOT_SQL) + """, placed as (
      select episode, t, 'obj1' as obj, 0 as n, 0e0 as a, 0e0 as x, 0e0 as y, 0e0 as z, l_n, r_n from run
      union all select episode, t, 'obj2', 2, a2, x2, y2, z2, l_n, r_n from run
      union all select episode, t, 'obj3', 3, a3, x3, y3, z3, l_n, r_n from run)
    select episode, frame_idx, 1280 as w, 480 as h, is_finished, cast(l_ok as integer) + cast(r_ok as integer) as n_hands,
      case when r_ok then case when r_g then 1e0 else 0e0 end end as right_grasp, case when r_ok then round(value, 5) end as right_joint,
      case when l_ok then round(value, 5) end as left_joint, obj,
      n > 0 and (l_n = n or r_n = n) as is_dynamic, round(x, 5) + 0e0 as x, round(y, 5) + 0e0 as y, round(z, 5) + 0e0 as z,
      round(cos(a), 5) + 0e0 as c, round(sin(a), 5) + 0e0 as s
    from placed join hand using (episode, t)""",
)
def robot_training_table(spark, sf_dir):
    rows = T.robot_table(*robot_inputs(spark, sf_dir), tail=4)
    at = lambda k: F.round(F.col("o.T")[k], 5) + F.lit(0.0)
    hand = lambda side: F.try_element_at("hands", F.lit(side))
    joint = lambda side: F.round(F.get(hand(side)["joints"], F.lit(0)), 5)
    rows = rows.select(
        "episode", "frame_idx", "w", "h", "is_finished", F.size("hands").alias("n_hands"), hand("right")["grasp"].alias("right_grasp"),
        joint("right").alias("right_joint"), joint("left").alias("left_joint"), F.explode("objects").alias("obj", "o"),
    )
    return rows.select("*", "o.is_dynamic", at(3).alias("x"), at(7).alias("y"), at(11).alias("z"), at(0).alias("c"), at(4).alias("s")).drop("o")


@query(
    "robot_session_meta",
    f"""with {FRAMES_SQL} select episode, 1280 as w, 480 as h, 30e0 as fps, episode % 2 = 0 as dual_arm, 'unknown' as source_type, 1e0 as focal, 'cam0' as cameras
      from frames where frame_idx = 0 and episode % 10 <> 3""",
)
def robot_session_meta(spark, sf_dir):
    meta = robot_inputs(spark, sf_dir)[2]
    return meta.select("episode", "w", "h", "fps", "dual_arm", "source_type", F.get(F.get("k", F.lit(0)), F.lit(0)).alias("focal"), F.array_join(F.map_keys("cameras"), ",").alias("cameras"))
