"""Registered queries of two-hand targets and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import evaluation as E
from framestride.operators import two_hands as H
from framestride.plans.feature_queries import MEAN, STD, records
from framestride.plans.registry import query
from framestride.plans.surrogate import FRAMES_SQL, table

HORIZON = 4
# Rounded values are moved a little off the ties, which the engines round differently.
#: Columns of ``actions`` in their order: positions, rotations and grasps, hand by hand.
ACTIONS = [f"{s}_{c}" for s in "lr" for c in "xyz"] + [f"{s}_r{k}" for s in "lr" for k in range(6)] + ["l_g", "r_g"]
OBJECT = [f"o_{c}" for c in "xyz"] + [f"o_r{k}" for k in range(6)]
TRACE = [f"{e}_{c}" for e in ("l", "r", "o") for c in "uv"]


def two_hands(spark, sf_dir):
    """The training records with a left hand that is seen on other frames than the right one."""
    i, value = F.col("event_id"), F.col("value")
    left = G.from_parts(G.rotation_z(-F.radians("value")), [F.col("x") - F.lit(0.02), F.col("y") + F.lit(0.03), F.lit(0.5)])
    entry = F.create_map(F.lit("left"), F.struct(F.array(*left).alias("T"), (value > 50).cast("double").alias("grasp")))
    t = records(spark, sf_dir)
    return t.withColumn("hands", F.when(i % 5 != 0, F.map_concat("hands", entry)).otherwise(F.col("hands")))


def _nine(e: str, a: str, x: str, y: str, z: str) -> str:
    mean = dict(zip("xyz", MEAN))
    std = dict(zip("xyz", STD))
    at = {"x": f"({x} - episode / 1000e0)", "y": y, "z": z}
    out = [f"({at[c]} - {mean[c]}e0) / ({std[c]}e0 + 1e-8) as {e}_{c}" for c in "xyz"]
    return ", ".join(out + [f"{v} / (1 + 1e-8) as {e}_r{k}" for k, v in enumerate((f"cos({a})", f"-sin({a})", f"sin({a})", f"cos({a})", "0e0", "0e0"))])


def _uv(e: str, x: str, y: str, z: str) -> str:
    # The camera stands at z = -1.
    return f"greatest(0e0, least(1e0, (700 * ({x}) / ({z} + 1) + 320) / 640)) as {e}_u, greatest(0e0, least(1e0, (700 * ({y}) / ({z} + 1) + 240) / 480)) as {e}_v"


def _held(columns: list[str], by: str) -> str:
    """Columns that go on where ``by`` is false."""
    return ", ".join(f"coalesce(last_value(case when {by} then {c} end ignore nulls) over w, 0e0) as {c}" for c in columns)


_R = ["x + 0.01e0", "y", "z"]
_L = ["x - 0.02e0", "y + 0.03e0", "0.5e0"]
TARGETS_SQL = f"""with {FRAMES_SQL}, steps as (
  select s.episode, s.frame_idx, j + 1 as step, f.episode is not null as here, f.* exclude (episode, frame_idx),
         f.episode is not null and f.event_id % 5 <> 0 as l_in, f.episode is not null and f.event_id % 7 <> 0 as r_in
  from frames s cross join range({HORIZON}) t(j) left join frames f on f.episode = s.episode and f.frame_idx = s.frame_idx + j + 1),
runs as (
  select *, r_in and grasp as held, radians(value * 3) as ra, (event_id % 5) / 50e0 as tx,
         sum(case when here and not (r_in and grasp) then 1 else 0 end) over (partition by episode, frame_idx order by step) as run from steps),
locks as (
  select *, first_value(case when held then struct_pack(a := ra, x := {_R[0]}, y := y, z := z, o := tx) end ignore nulls)
         over (partition by episode, frame_idx, run order by step rows between unbounded preceding and current row) as lock from runs),
objects as (
  select *, case when held then ra - lock.a else 0e0 end as oa,
         case when held then {_R[0]} + cos(ra - lock.a) * (lock.o - lock.x) + sin(ra - lock.a) * lock.y else tx end as ox,
         case when held then y + sin(ra - lock.a) * (lock.o - lock.x) - cos(ra - lock.a) * lock.y else 0e0 end as oy,
         case when held then z - lock.z else 0e0 end as oz from locks),
values_ as (
  select episode, frame_idx, step, here, l_in, r_in, {_nine("l", "-radians(value)", *_L)}, {_nine("r", "ra", *_R)}, {_nine("o", "oa", "ox", "oy", "oz")},
         case when value > 50 then 1e0 else 0e0 end as l_g, case when grasp then 1e0 else 0e0 end as r_g,
         {_uv("l", *_L)}, {_uv("r", *_R)}, {_uv("o", "ox", "oy", "oz")},
         case when is_last and episode % 3 = 0 then 1e0 else 0e0 end as done from objects),
kept as (
  select episode, frame_idx, step, {_held([c for c in ACTIONS + TRACE if c[0] == "l"], "l_in")}, {_held([c for c in ACTIONS + TRACE if c[0] == "r"], "r_in")},
         {_held(OBJECT + [c for c in TRACE if c[0] == "o"] + ["done"], "here")}
  from values_ window w as (partition by episode, frame_idx order by step))
select episode, frame_idx, step, {", ".join(f"round({c} + 3e-7, 5) + 0e0 as {c}" for c in ACTIONS + OBJECT + TRACE)}, done from kept"""


@query("two_hand_targets", TARGETS_SQL)
def two_hand_targets(spark, sf_dir):
    made = H.two_hand_targets(two_hands(spark, sf_dir), HORIZON, MEAN, STD)
    steps = F.posexplode(F.arrays_zip("actions", "object", "trace", "done")).alias("at", "s")
    rows = made.select("episode", "frame_idx", steps)
    named = [(c, f"s.{kind}", k) for kind, names in (("actions", ACTIONS), ("object", OBJECT), ("trace", TRACE)) for k, c in enumerate(names)]
    columns = [(F.round(F.col(kind)[k] + F.lit(3e-7), 5) + F.lit(0.0)).alias(c) for c, kind, k in named]
    return rows.select("episode", "frame_idx", (F.col("at") + 1).alias("step"), *columns, F.col("s.done")[0].alias("done"))


PREDICTIONS_SQL = """with p as (select l_orderkey % 32 as batch_id, l_linenumber as k,
   case when l_partkey % 7 <> 0 then struct_pack(pos := sqrt((l_quantity / 50) ** 2 + l_discount ** 2 + l_tax ** 2), ang := l_quantity, prob := l_discount * 10, g := l_returnflag = 'R') end as l,
   case when l_partkey % 5 <> 0 then struct_pack(pos := sqrt(l_tax ** 2 + l_tax ** 2 + l_discount ** 2), ang := l_quantity / 2, prob := l_tax * 10, g := l_linestatus = 'F') end as r,
   l_tax * 10 > 0.5e0 as dp, l_linestatus = 'F' as dt from lineitem),
 s as (select 'left' as side, l as h, batch_id, k from p where l is not null union all select 'right', r, batch_id, k from p where r is not null),
 e as (select side, batch_id, k, h.pos as pos, degrees(acos(greatest(-0.999999e0, least(0.999999e0, cos(radians(h.ang)))))) as rot, h.prob >= 0.5e0 as pred, h.g as g from s)"""
_F1 = "2 * (tp / greatest(1e0, tp + fp)) * (tp / greatest(1e0, tp + fn)) / greatest(1e-8, (tp / greatest(1e0, tp + fp)) + (tp / greatest(1e0, tp + fn)))"


def predictions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    zeros = F.array(*[F.lit(0.0)] * 3)
    level = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])

    def hand(pos, angle, prob, true):
        six = F.array(*G.encode_6d(G.rotation_z(F.radians(angle))))
        return F.struct(F.array(*pos).alias("pos_pred"), zeros.alias("pos_true"), six.alias("o6d_pred"), level.alias("o6d_true"), prob.alias("g_prob"), true.cast("double").alias("g_true"))

    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return x.select(
        (F.col("l_orderkey") % 32).alias("batch_id"), F.col("l_linenumber").alias("k"),
        F.when(F.col("l_partkey") % 7 != 0, hand([q / 50, d, t], q, d * 10, F.col("l_returnflag") == "R")).alias("left"),
        F.when(F.col("l_partkey") % 5 != 0, hand([t, t, d], q / 2, t * 10, F.col("l_linestatus") == "F")).alias("right"),
        (t * 10).alias("done_prob"), (F.col("l_linestatus") == "F").cast("double").alias("done_true"),
    )


def _rounded(rows, *names):
    return rows.select(*names, *[F.round(c, 6).alias(c) for c in ("pos_err", "rot_err", "f1")])


@query(
    "two_hand_evaluation",
    PREDICTIONS_SQL + f""", j as (select batch_id, k, case when l is not null or r is not null then sqrt(coalesce(l.pos ** 2, 0) + coalesce(r.pos ** 2, 0)) end as pos,
      (case when l is not null then degrees(acos(greatest(-0.999999e0, least(0.999999e0, cos(radians(l.ang)))))) else 0 end
        + case when r is not null then degrees(acos(greatest(-0.999999e0, least(0.999999e0, cos(radians(r.ang)))))) else 0 end)
        / nullif(cast(l is not null as integer) + cast(r is not null as integer), 0) as rot, dp = dt as done from p),
    jb as (select batch_id, k, avg(pos) as pos, avg(rot) as rot, count(*) filter (done) as done, count(*) as n from j group by batch_id, k),
    js as (select k, avg(pos) as pos_err, avg(rot) as rot_err, sum(done) as done, sum(n) as n from jb group by k),
    g as (select k, count(*) filter (pred and g) as tp, count(*) filter (pred and not g) as fp, count(*) filter (not pred and g) as fn from e group by k)
    select k, cast(n as bigint) as n, cast(done as bigint) as done, round(pos_err, 6) as pos_err, round(rot_err, 6) as rot_err, round({_F1}, 6) as f1 from js join g using (k)""",
)
def two_hand_evaluation(spark, sf_dir):
    return _rounded(H.two_hands_by_step(H.side_errors(predictions(spark, sf_dir))), "k", "n", "done")


@query(
    "hand_evaluation",
    PREDICTIONS_SQL + f""", b as (select side, batch_id, k, avg(pos) as pos, avg(rot) as rot, count(*) filter (pred and g) as tp, count(*) filter (pred and not g) as fp,
      count(*) filter (not pred and g) as fn, count(*) as n from e group by side, batch_id, k),
    s2 as (select side, k, avg(pos) as pos_err, avg(rot) as rot_err, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(n) as n from b group by side, k)
    select k, side, cast(n as bigint) as n, round(pos_err, 6) as pos_err, round(rot_err, 6) as rot_err, round({_F1}, 6) as f1 from s2""",
)
def hand_evaluation(spark, sf_dir):
    return _rounded(H.hands_by_step(H.side_errors(predictions(spark, sf_dir))), "k", "side", "n")


@query(
    "two_hand_summary",
    PREDICTIONS_SQL + """, j as (select batch_id, k, case when l is not null or r is not null then sqrt(coalesce(l.pos ** 2, 0) + coalesce(r.pos ** 2, 0)) end as pos from p),
    jb as (select batch_id, k, avg(pos) as pos, count(*) as n from j group by batch_id, k), js as (select k, avg(pos) as pos_err, sum(n) as n from jb group by k)
    select cast(max(n) as bigint) as frames, round(max(case when k = 1 then pos_err end), 6) as pos_err_k1_m, round(sum(pos_err) / 7, 6) as pos_err_w_m from js""",
)
def two_hand_summary(spark, sf_dir):
    out = E.horizon_metrics(H.two_hands_by_step(H.side_errors(predictions(spark, sf_dir))), 7)
    return out.select("frames", F.round("pos_err_k1_m", 6).alias("pos_err_k1_m"), F.round("pos_err_w_m", 6).alias("pos_err_w_m"))
