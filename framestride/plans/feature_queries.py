"""Registered queries for dataset assembly, training features and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import dataset as D
from framestride.operators import evaluation as E
from framestride.operators import features as X
from framestride.plans.audit_plan import audit
from framestride.plans.audit_queries import ISSUES_SQL, SUMMARY_SELECT
from framestride.plans.registry import query
from framestride.plans.surrogate import ENTITIES_SQL, FRAMES_SQL, frames, table, training

F0 = f"with {FRAMES_SQL}"
MEAN, STD = (0.1, 0.2, 0.3), (0.5, 0.6, 0.7)


def r(c: str, n: int):
    return F.round(c, n).alias(c)


# --- assembly ---------------------------------------------------------------------------------------


def parts(spark, sf_dir):
    f = frames(spark, sf_dir)
    i = F.col("event_id")
    return f, {
        "cameras": f.where(i % 17 != 0).select("episode", "frame_idx", "x"),
        "hands": f.where(i % 19 != 0).select("episode", "frame_idx", (i % 7 != 0).alias("has_hand")),
        "phases": f.where(i % 23 != 0).select("episode", "frame_idx", "grasp"),
        "slam": f.where(i % 29 != 0).select("episode", "frame_idx", "y"),
    }


ALL4 = "event_id % 17 <> 0 and event_id % 19 <> 0 and event_id % 23 <> 0 and event_id % 29 <> 0"


@query("four_way_frame_join", F0 + f" select episode, frame_idx, x, event_id % 7 <> 0 as has_hand, grasp, y from frames where {ALL4}")
def four_way_frame_join(spark, sf_dir):
    _, p = parts(spark, sf_dir)
    return D.join_frames(p["cameras"], p["hands"], p["phases"], p["slam"])


@query(
    "dataset_counters",
    F0 + f""" select episode, count(*) as total, count(*) filter ({ALL4}) as valid, count(*) filter (not ({ALL4})) as discarded_missing_file,
      count(*) filter ({ALL4} and event_id % 7 = 0) as discarded_no_hand from frames group by episode""",
)
def dataset_counters(spark, sf_dir):
    f, p = parts(spark, sf_dir)
    return D.frame_counters(f, p)


@query(
    "trainable_sample_index",
    F0 + """ select episode, frame_idx, row_number() over (order by episode, frame_idx) - 1 as sample_id from frames
      where event_id % 7 <> 0""",
)
def trainable_sample_index(spark, sf_dir):
    return D.sample_index(training(spark, sf_dir))


@query(
    "position_sampling",
    F0 + " select episode, frame_idx, frame_idx % 4 = 0 as sampled from frames where frame_idx < 30",
)
def position_sampling(spark, sf_dir):
    return D.sample_positions(frames(spark, sf_dir), 4, 30).select("episode", "frame_idx", "sampled")


SESSIONS_SQL = """with s as (select distinct user_id from events),
 t as (select 'mps_' || lpad(cast(user_id as varchar), 5, '0') || '_' || lpad(cast(user_id // 3 % 1000 as varchar), 3, '0') || '_vrs' as episode,
   case user_id % 3 when 0 then 'glasses' when 1 then 'teleop' else 'headset' end as source, user_id // 3 as session_index from s)"""


def sessions(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    name = F.concat(
        F.lit("mps_"), F.lpad(F.col("u").cast("string"), 5, "0"), F.lit("_"),
        F.lpad((F.floor(F.col("u") / 3) % 1000).cast("string"), 3, "0"), F.lit("_vrs"),
    )
    source = F.when(F.col("u") % 3 == 0, "glasses").when(F.col("u") % 3 == 1, "teleop").otherwise("headset")
    return u.select(name.alias("episode"), source.alias("source"), F.floor(F.col("u") / 3).cast("long").alias("session_index"))


@query(
    "session_split",
    SESSIONS_SQL + """, q as (select *, row_number() over (partition by source order by session_index) - 1 as rk from t where source <> 'headset'),
      k as (select *, case when source = 'glasses' and rk = 0 then 'eval'
        when rk - case when source = 'glasses' then 1 else 0 end < case source when 'glasses' then 20 else 10 end then 'train' end as split from q)
      select episode, source, session_index, split from k where split is not null""",
)
def session_split(spark, sf_dir):
    s = D.session_split(sessions(spark, sf_dir), {"glasses": 20, "teleop": 10, "headset": 0}, "glasses")
    return s.select("episode", "source", "session_index", "split")


@query(
    "split_by_name",
    SESSIONS_SQL + " select episode, case when episode like 'mps\\_%\\_000\\_vrs' escape '\\' then 'eval' else 'train' end as split from t",
)
def split_by_name(spark, sf_dir):
    return sessions(spark, sf_dir).select("episode", D.split_label(F.col("episode"), "mps_*_000_vrs").alias("split"))


@query(
    "split_manifest",
    SESSIONS_SQL + """ select episode, case when episode = 'mps_00000_000_vrs' then 'eval' else 'train' end as split from t
      where episode in ('mps_00000_000_vrs', 'mps_00003_001_vrs')""",
)
def split_manifest(spark, sf_dir):
    m = {"eval": ["mps_00000_000_vrs"], "train": ["mps_00003_001_vrs"]}
    return D.apply_split_manifest(sessions(spark, sf_dir), m).select("episode", "split")


@query(
    "finished_labels",
    F0 + """ select episode, frame_idx, case when event_id % 5 = 4 then 1e0 else 0e0 end as by_mode,
      coalesce(case when event_id % 6 = 0 then 1e0 end, case when frame_idx >= n_frames - 10 then 1e0 else 0e0 end) as is_finished from frames""",
)
def finished_labels(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("flag", F.when(F.col("event_id") % 6 == 0, True))
    o = D.finished_by_tail(f, 10)
    return o.select("episode", "frame_idx", D.finished_by_mode(F.col("event_id") % 5).alias("by_mode"), "is_finished")


@query(
    "observation_paths",
    F0 + " select episode, frame_idx, 'data/' || cast(episode as varchar) || '/' || lpad(cast(frame_idx as varchar), 5, '0') || '/rgb.png' as path from frames",
)
def observation_paths(spark, sf_dir):
    f = frames(spark, sf_dir)
    frame = F.lpad(F.col("frame_idx").cast("string"), 5, "0")
    return f.select(
        "episode", "frame_idx", D.observation_path(F.lit("data//"), F.col("episode").cast("string"), frame, F.lit("rgb.png")).alias("path")
    )


# --- features -----------------------------------------------------------------------------------------


def records(spark, sf_dir):
    """Training records with a reference camera and an anchor pose per recording."""
    eye = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    cam = [F.lit(float(v)) for v in eye]
    cam[3] = F.col("episode") / F.lit(1000.0)
    fixed = [700.0, 0.0, 320.0, 0.0, 700.0, 240.0, 0.0, 0.0, 1.0]
    t = training(spark, sf_dir)
    c2w = [F.lit(float(v)) for v in eye]
    c2w[11] = F.lit(-1.0)
    return t.withColumns(
        {
            "cam0": F.array(*cam),
            "anchor": F.array(*[F.lit(float(v)) for v in eye]),
            "anchor_key": F.lit("obj1"),
            "k": F.array(*[F.lit(v) for v in fixed]),
            "c2w": F.array(*c2w),
        }
    )


@query(
    "interaction_tokens",
    F0 + """ select episode, frame_idx, case when event_id % 7 <> 0 then 2e0 else 0e0 end as hand_type,
      round(case when event_id % 7 <> 0 then (x + 0.01e0 - episode / 1000e0 - 0.1e0) / (0.5e0 + 1e-8) else 0 end, 6) as hand_x,
      round(((event_id % 5) / 50e0 - episode / 1000e0 - 0.1e0) / (0.5e0 + 1e-8), 6) as anchor_x,
      round(case when event_id % 7 <> 0 then (y - 0.2e0) / (0.6e0 + 1e-8) else 0 end, 6) as hand_in_anchor_y,
      case when event_id % 7 <> 0 then 2 else 1 end as n_tokens from frames""",
)
def interaction_tokens(spark, sf_dir):
    t = X.add_tokens(records(spark, sf_dir), MEAN, STD)
    at = lambda i, j: F.get(F.get("tokens", F.lit(i)), F.lit(j))
    return t.select(
        "episode", "frame_idx", at(0, 0).alias("hand_type"), F.round(at(0, 1), 6).alias("hand_x"), F.round(at(1, 1), 6).alias("anchor_x"),
        F.round(at(1, 11), 6).alias("hand_in_anchor_y"), F.size(F.filter("mask", lambda m: m)).alias("n_tokens"),
    )


@query("tokens_from_poses")
def tokens_from_poses(spark, sf_dir):
    rec = records(spark, sf_dir).where("event_id % 7 <> 0")
    rows = rec.select(
        "episode", "frame_idx", F.col("hands")["right"]["T"].alias("hand"), F.col("grasp"),
        F.array(F.col("objects")["obj1"]["T"], F.col("anchor")).alias("object_poses"),
    )
    t = X.tokens_from_poses(rows, MEAN, STD)
    return t.select("episode", "frame_idx", F.transform("tokens", lambda a: F.transform(a, lambda v: F.round(v, 5))).alias("tokens"), "mask")


@query(
    "future_frames",
    F0 + """, k as (select * from frames where event_id % 9 <> 0), h as (select episode, frame_idx, j + 1 as k from k, range(4) t(j))
      select h.episode, h.frame_idx, h.k, b.event_id as future_event from h left join k b on b.episode = h.episode and b.frame_idx = h.frame_idx + 2 * h.k""",
)
def future_frames(spark, sf_dir):
    f = frames(spark, sf_dir).where(F.col("event_id") % 9 != 0).select("episode", "frame_idx", "event_id")
    o = X.future_rows(f.select("episode", "frame_idx"), f, 4, 2)
    return o.select("episode", "frame_idx", "k", F.col("future.event_id").alias("future_event"))


@query(
    "action_targets",
    F0 + """, h as (select f.episode, f.frame_idx, j + 1 as k from frames f, range(4) t(j)),
      q as (select h.*, b.episode is not null as here, case when b.event_id % 7 <> 0 then (b.x + 0.01e0 - h.episode / 1000e0 - 0.1e0) / (0.5e0 + 1e-8) end as hx,
              case when b.event_id % 7 <> 0 then case when b.grasp then 1e0 else 0e0 end end as g,
              case when b.episode is not null then case when b.is_last and b.episode % 3 = 0 then 1e0 else 0e0 end end as d
            from h left join frames b on b.episode = h.episode and b.frame_idx = h.frame_idx + h.k)
      select episode, frame_idx, k, round(coalesce(last_value(hx ignore nulls) over w, 0), 6) as hand_x,
        coalesce(last_value(g ignore nulls) over w, 0e0) as grasp, coalesce(last_value(d ignore nulls) over w, 0e0) as done
      from q window w as (partition by episode, frame_idx order by k rows between unbounded preceding and current row)""",
)
def action_targets(spark, sf_dir):
    rec = records(spark, sf_dir)
    o = X.targets(rec, rec, 4, MEAN, STD)
    return o.select("episode", "frame_idx", "k", F.round(F.get("hand", F.lit(0)), 6).alias("hand_x"), "grasp", "done")


@query("delta_action_arrays")
def delta_action_arrays(spark, sf_dir):
    rec = records(spark, sf_dir)
    o = X.action_arrays(X.targets(rec, rec, 4, MEAN, STD, "anchor_frame", "delta"))
    hand = F.transform("steps", lambda s: F.transform(s["hand"], lambda v: F.round(v, 5)))
    obj = F.transform("steps", lambda s: F.transform(s["object"], lambda v: F.round(v, 5)))
    return o.select("episode", "frame_idx", hand.alias("hand"), obj.alias("object"))


@query("jittered_targets")
def jittered_targets(spark, sf_dir):
    rec = records(spark, sf_dir)
    o = X.targets(rec, rec, 2, MEAN, STD, jitter=(0.005, 2.0, 7))
    return o.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "anchor_pixels",
    F0 + """ select episode, frame_idx, round(greatest(0e0, least(1e0, (700 * (event_id % 5) / 50e0 + 320) / 640)), 6) as u, 0.5e0 as v from frames""",
)
def anchor_pixels(spark, sf_dir):
    o = X.anchor_pixel(records(spark, sf_dir))
    return o.select("episode", "frame_idx", F.round(F.get("anchor_uv", F.lit(0)), 6).alias("u"), F.round(F.get("anchor_uv", F.lit(1)), 6).alias("v"))


@query(
    "future_tokens",
    F0 + """ select a.episode, a.frame_idx, round(((coalesce(b.event_id, a.event_id) % 5) / 50e0 - a.episode / 1000e0 - 0.1e0) / (0.5e0 + 1e-8), 6) as anchor_x
      from frames a left join frames b on a.episode = b.episode and b.frame_idx = a.frame_idx + 4""",
)
def future_tokens(spark, sf_dir):
    rec = records(spark, sf_dir)
    o = X.future_tokens(rec, rec, 4, MEAN, STD)
    return o.select("episode", "frame_idx", F.round(F.get(F.get("tokens", F.lit(1)), F.lit(1)), 6).alias("anchor_x"))


@query(
    "interpolated_tokens",
    F0 + """ select a.episode, a.frame_idx, round((((a.event_id % 5) * 0.75e0 + (b.event_id % 5) * 0.25e0) / 50e0 - a.episode / 1000e0 - 0.1e0) / (0.5e0 + 1e-8), 6) as anchor_x,
      a.event_id % 7 <> 0 and b.event_id % 7 <> 0 as hand from frames a join frames b on a.episode = b.episode and b.frame_idx = a.frame_idx + 1""",
)
def interpolated_tokens(spark, sf_dir):
    o = X.interpolated_tokens(records(spark, sf_dir), F.lit(0.25), MEAN, STD)
    return o.select(
        "episode", "frame_idx", F.round(F.get(F.get("tokens", F.lit(1)), F.lit(1)), 6).alias("anchor_x"), F.get("mask", F.lit(0)).alias("hand")
    )


@query(
    "safe_stride",
    F0 + """, k as (select * from frames where event_id % 9 <> 0)
      select a.episode, a.frame_idx, case when c.episode is not null then 3 when b.episode is not null then 2 else 1 end as stride from k a
      left join k b on b.episode = a.episode and b.frame_idx = a.frame_idx + 8 left join k c on c.episode = a.episode and c.frame_idx = a.frame_idx + 12""",
)
def safe_stride(spark, sf_dir):
    f = frames(spark, sf_dir).where(F.col("event_id") % 9 != 0)
    return X.safe_stride(f, f, 4, 3)


@query(
    "position_statistics",
    F0 + """, t as (select x + 0.01e0 - episode / 1000e0 as px, y as py from frames where event_id % 7 <> 0)
      select count(*) as hand_tokens, round(avg(px), 6) as mean_x, round(avg(py), 6) as mean_y, round(greatest(stddev_pop(px), 1e-4), 6) as std_x from t""",
)
def position_statistics(spark, sf_dir):
    t = X.add_tokens(records(spark, sf_dir), (0.0, 0.0, 0.0), (1.0 - 1e-8,) * 3)
    o = X.position_stats(t)
    return o.select("hand_tokens", r("mean_x", 6), r("mean_y", 6), r("std_x", 6))


@query("zero_state_ratio", F0 + " select round(avg(case when event_id % 7 = 0 then 1e0 else 0e0 end), 6) as zero_state_ratio from frames")
def zero_state_ratio(spark, sf_dir):
    t = X.add_tokens(records(spark, sf_dir), MEAN, STD)
    return X.zero_state_ratio(t).select(r("zero_state_ratio", 6))


@query(
    "decoded_predictions",
    F0 + " select episode, frame_idx, round(x * 0.5e0 + 0.1e0, 6) as px, round(cos(radians(value)) / (1 + 1e-8) / (1 + 0e0), 6) as r00 from frames",
)
def decoded_predictions(spark, sf_dir):
    f = frames(spark, sf_dir)
    six = G.encode_6d(G.rotation_z(F.radians("value")))
    bridge = F.array(*[F.lit(float(v)) for v in X.IDENTITY])
    f = f.withColumn("six", F.array(*six)).withColumn("p", F.array("x", "y", "z"))
    pose = X.decode_prediction(F.col("p"), F.col("six"), MEAN, STD, bridge)
    return f.select("episode", "frame_idx", F.round(F.get(pose, F.lit(3)), 6).alias("px"), F.round(F.get(pose, F.lit(0)), 6).alias("r00"))


# --- evaluation --------------------------------------------------------------------------------------------

PRED_SQL = """with p as (select l_orderkey % 32 as batch_id, l_linenumber as k, l_discount * 10 as g_prob,
   case when l_returnflag = 'R' then 1e0 else 0e0 end as g_true, l_tax * 10 as done_prob, case when l_linestatus = 'F' then 1e0 else 0e0 end as done_true,
   sqrt((l_quantity / 50) ** 2 + l_discount ** 2 + l_tax ** 2) as pos, l_quantity as ang from lineitem),
 e as (select *, degrees(acos(greatest(-0.999999e0, least(0.999999e0, cos(radians(ang)))))) as rot from p),
 b as (select batch_id, k, avg(pos) as pos, avg(rot) as rot, count(*) filter (g_prob >= 0.5 and g_true >= 0.5) as tp,
   count(*) filter (g_prob >= 0.5 and g_true < 0.5) as fp, count(*) filter (g_prob < 0.5 and g_true >= 0.5) as fn,
   count(*) filter ((done_prob > 0.5) = (done_true > 0.5)) as done, count(*) as n from e group by batch_id, k),
 s as (select k, avg(pos) as pos_err, avg(rot) as rot_err, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(done) as done, sum(n) as n from b group by k),
 m as (select *, tp / greatest(1e0, tp + fp) as pr, tp / greatest(1e0, tp + fn) as rc from s),
 f as (select *, 2 * pr * rc / greatest(1e-8, pr + rc) as f1 from m)"""


def predictions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    zero = F.lit(0.0)
    return x.select(
        (F.col("l_orderkey") % 32).alias("batch_id"), F.col("l_linenumber").alias("k"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")).alias("pos_pred"), F.array(zero, zero, zero).alias("pos_true"),
        F.array(*G.encode_6d(G.rotation_z(F.radians("l_quantity")))).alias("o6d_pred"),
        F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]).alias("o6d_true"),
        (F.col("l_discount") * 10).alias("g_prob"), (F.col("l_returnflag") == "R").cast("double").alias("g_true"),
        (F.col("l_tax") * 10).alias("done_prob"), (F.col("l_linestatus") == "F").cast("double").alias("done_true"),
    )


@query(
    "horizon_evaluation",
    PRED_SQL + " select k, cast(n as bigint) as n, cast(tp as bigint) as tp, round(pos_err, 6) as pos_err, round(rot_err, 6) as rot_err, round(f1, 8) as f1 from f",
)
def horizon_evaluation(spark, sf_dir):
    o = E.horizon_by_step(E.step_errors(predictions(spark, sf_dir)))
    return o.select("k", "n", "tp", r("pos_err", 6), r("rot_err", 6), r("f1", 8))


@query(
    "horizon_summary",
    PRED_SQL + """, w as (select k, exp(-0.1e0 * (k - 1)) as w from f), t as (select sum(exp(-0.1e0 * j)) as total from range(7) r(j))
      select cast(max(n) as bigint) as frames, round(sum(done) / sum(n), 8) as done_acc, round(max(case when k = 1 then pos_err end), 6) as pos_err_k1_m,
        round(max(case when k = 7 then pos_err end), 6) as pos_err_kK_m, round(sum(pos_err * w / total), 6) as pos_err_w_m,
        round(sum(f1 * w / total), 6) as grasp_f1_w from f join w using (k), t""",
)
def horizon_summary(spark, sf_dir):
    o = E.horizon_metrics(E.horizon_by_step(E.step_errors(predictions(spark, sf_dir))), 7, "exp", 0.1)
    return o.select("frames", r("done_acc", 8), r("pos_err_k1_m", 6), r("pos_err_kK_m", 6), r("pos_err_w_m", 6), r("grasp_f1_w", 6))


RUNS_SQL = """with r as (select o_custkey as steps, o_totalprice / 1e6 as pos_err_w_m, o_orderkey % 180 as rot_err_w_deg, (o_orderkey % 100) / 100e0 as grasp_f1_w,
   case o_orderstatus when 'F' then 'SUCCESS' else 'EVAL_ERROR' end as status, o_orderkey as experiment_id from orders)"""


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("steps"), (F.col("o_totalprice") / F.lit(1e6)).alias("pos_err_w_m"), (k % 180).cast("double").alias("rot_err_w_deg"),
        ((k % 100) / F.lit(100.0)).alias("grasp_f1_w"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("EVAL_ERROR").alias("status"),
        k.alias("experiment_id"),
    )


@query(
    "repeat_summary",
    RUNS_SQL + """ select steps, count(*) as runs, round(avg(pos_err_w_m), 13) as mean, round(coalesce(stddev_samp(pos_err_w_m), 0), 8) as std,
      min(pos_err_w_m) as min, max(pos_err_w_m) as max from r group by steps""",
)
def repeat_summary(spark, sf_dir):
    o = E.repeat_summary(runs(spark, sf_dir), ["pos_err_w_m"])
    return o.select("steps", "runs", r("mean", 13), r("std", 8), "min", "max")


@query(
    "experiment_leaderboard",
    RUNS_SQL + """, s as (select *, pos_err_w_m + rot_err_w_deg / 100e0 - grasp_f1_w * 0.1e0 as score from r where status = 'SUCCESS')
      select experiment_id, round(score, 8) as score, row_number() over (order by score, experiment_id) as rank from s""",
)
def experiment_leaderboard(spark, sf_dir):
    s = runs(spark, sf_dir).withColumn("score", E.score(F.col("pos_err_w_m"), F.col("rot_err_w_deg"), F.col("grasp_f1_w")))
    return E.leaderboard(s).select("experiment_id", r("score", 8), "rank")


@query(
    "experiment_status",
    """with s as (select o_custkey as e, max(o_orderkey) as last from orders where o_orderkey % 3 = 0 group by o_custkey),
       c as (select distinct o_custkey as e from orders)
      select c.e as experiment_id, case when s.last is null then 'EVAL_MISSING' when last % 5 = 0 then 'EVAL_ERROR' when last % 7 = 0 then 'NAN'
        else 'SUCCESS' end as status from c left join s using (e)""",
)
def experiment_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    snaps = o.where(k % 3 == 0).select(
        F.col("o_custkey").alias("experiment_id"), F.format_string("eval_ep_%012d.json", k).alias("file_name"), F.lit(True).alias("ok"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "NaN").otherwise("0.5").alias("pos_err_w_m"), F.lit("20").alias("rot_err_w_deg"),
        F.lit("0.6").alias("grasp_f1_w"),
    )
    every = o.select(F.col("o_custkey").alias("experiment_id")).distinct()
    return E.experiment_results(every, snaps).select("experiment_id", "status")


@query(
    "value_histogram",
    F0 + """, s as (select min(value) as lo, max(value) as hi, least(40, greatest(10, floor(sqrt(count(*))))) as b from frames)
      select cast(least(floor((value - lo) / (hi - lo) * b), b - 1) as integer) as bin, count(*) as count from frames, s group by 1""",
)
def value_histogram(spark, sf_dir):
    return E.histogram(frames(spark, sf_dir), "value")


@query(
    "value_quartiles",
    F0 + " select event_type, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as q2, round(quantile_cont(value, 0.75), 6) as q3 from frames group by event_type",
)
def value_quartiles(spark, sf_dir):
    o = E.box_plot(frames(spark, sf_dir), "event_type", "value")
    return o.select("event_type", r("q1", 6), r("q2", 6), r("q3", 6))


@query("longest_episodes", F0 + " select episode, n_frames as frames from frames where is_last order by n_frames desc, episode limit 30")
def longest_episodes(spark, sf_dir):
    s = frames(spark, sf_dir).groupBy("episode").agg(F.count(F.lit(1)).alias("frames"))
    return E.longest_episodes(s)


@query(
    "worst_episodes",
    f"with {ENTITIES_SQL}{ISSUES_SQL} select episode, errors, warnings from ({SUMMARY_SELECT}) order by errors desc, warnings desc, episode limit 20",
)
def worst_episodes(spark, sf_dir):
    return E.worst_episodes(audit(training(spark, sf_dir)).episodes()).select("episode", "errors", "warnings")


@query(
    "report_issue_rows",
    f"with {ENTITIES_SQL}{ISSUES_SQL} select cast(episode as varchar) as episode, frame, metric, severity from issues where severity <> 'info' "
    "order by cast(episode as varchar), frame, metric, severity limit 80",
)
def report_issue_rows(spark, sf_dir):
    return E.first_issues(audit(training(spark, sf_dir)).issues).select("episode", "frame", "metric", "severity")
