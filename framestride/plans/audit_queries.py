"""Registered audit queries on the surrogate frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framestride.operators import audit as A
from framestride.operators import series as S
from framestride.plans.audit_plan import audit
from framestride.plans.registry import query
from framestride.plans.surrogate import ENTITIES_SQL, FRAMES_SQL, frames, table, training

STEPS_SQL = """,
steps as (
  select *, ts_us - lag(ts_us) over (partition by episode order by frame_idx) as step from frames),
clock as (
  select episode, s as scale, m * s as med from (
    select episode, case when median(abs(step)) >= 1e7 then 1e-9 when median(abs(step)) >= 1e4 then 1e-6
                         when median(abs(step)) >= 10 then 1e-3 else 1e0 end as s,
           median(case when step > 0 then step end) as m
    from steps group by episode))"""

TEMPORAL_SQL = STEPS_SQL + """,
temporal as (
  select s.*, s.step * c.scale as dt, c.med, s.ts_us * c.scale as ts_s, c.scale
  from steps s left join clock c using (episode))"""

MOTION_SQL = TEMPORAL_SQL + """,
pairs as (
  select e.*, t.ts_s,
         lag(e.frame_idx) over w as pf, lag(e.ok) over w as pok, lag(a) over w as pa, lag(s) over w as ps,
         lag(px) over w as qx, lag(py) over w as qy, lag(pz) over w as qz, lag(t.ts_s) over w as pt
  from entities e join temporal t using (episode, frame_idx)
  window w as (partition by e.episode, entity order by e.frame_idx)),
motion as (
  select *, sqrt((px-qx)**2 + (py-qy)**2 + (pz-qz)**2) as step_m,
         sqrt((px-qx)**2 + (py-qy)**2 + (pz-qz)**2) / (ts_s - pt) as speed,
         degrees(acos(greatest(-1e0, least(1e0,
           (2*s*ps*cos(a)*cos(pa) + 2*s*ps*sin(a)*sin(pa) + s*ps - 1) / 2)))) as rot
  from pairs where true),
valid_motion as (
  select episode, frame_idx, entity, kind,
         case when pf = frame_idx - 1 and ok and pok then step_m end as step_m,
         case when pf = frame_idx - 1 and ok and pok and ts_s <> pt then speed end as speed,
         case when pf = frame_idx - 1 and ok and pok then rot end as rot
  from motion)"""

ISSUES_SQL = MOTION_SQL + """,
limits as (
  select * from (values ('camera', 0.2e0, 3e0, 90e0), ('hand', 0.12e0, 2e0, 70e0), ('object', 0.15e0, 2e0, 80e0))
  as v(kind, jump, fast, turn)),
issues as (
  select episode, cast(frame_idx as varchar) as frame, 'error' as severity, 'temporal' as category, 'dt' as metric
  from temporal where frame_idx > 0 and (dt is null or dt <= 0)
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'temporal', 'dt' from temporal
  where frame_idx > 0 and dt > 0 and dt > med * 1.8e0
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'schema', 'metadata.k' from frames where event_id % 109 = 0
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'tracking', 'hands' from frames where event_id % 7 = 0
  union all
  select episode, cast(frame_idx as varchar), 'error', 'geometry', entity || '_T' from entities where not ok
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'geometry', entity || m.n
  from entities, (values ('_ortho_err', 0.03e0), ('_det', 0.03e0)) as m(n, lim)
  where ok and s > 1
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'geometry', entity || '_bottom_err'
  from entities where ok and bottom > 0.001
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'trajectory', entity || '_translation_step'
  from valid_motion join limits using (kind) where step_m > jump
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'trajectory', entity || '_speed'
  from valid_motion join limits using (kind) where speed > fast
  union all
  select episode, cast(frame_idx as varchar), 'warning', 'trajectory', entity || '_rotation_step_deg'
  from valid_motion join limits using (kind) where rot > turn
  union all
  select episode, '*', 'warning', 'labels', 'anchor_key' from frames
  where episode % 10 = 3 group by episode having max(frame_idx) >= 1
  union all
  select episode, '*', 'warning', 'labels', 'is_finished' from frames group by episode having min(episode) % 3 <> 0
  union all
  select episode, '*', 'info', 'labels', entity || '_grasp' from entities where grasp is not null
  group by episode, entity having avg(grasp) in (0, 1)
)"""

SUMMARY_SELECT = """
select f.episode, f.frames, round(f.duration_s, 4) as duration_s, f.anchor_count,
       coalesce(i.errors, 0) as errors, coalesce(i.warnings, 0) as warnings, coalesce(i.infos, 0) as infos
from (select episode, count(*) as frames, max(ts_s) - min(ts_s) as duration_s,
             count(distinct case when episode % 10 = 3 and frame_idx % 2 = 1 then 'obj2' else 'obj1' end) as anchor_count
      from temporal group by episode) f
left join (select episode, count(*) filter (severity = 'error') as errors,
                  count(*) filter (severity = 'warning') as warnings,
                  count(*) filter (severity = 'info') as infos from issues group by episode) i
using (episode)"""


@query("audit_episode_summary", f"with {ENTITIES_SQL}{ISSUES_SQL}{SUMMARY_SELECT}")
def audit_episode_summary(spark, sf_dir):
    out = audit(training(spark, sf_dir)).episodes()
    return out.select(
        "episode", "frames", F.round("duration_s", 4).alias("duration_s"), "anchor_count", "errors", "warnings", "infos"
    )


@query(
    "audit_issue_counts",
    f"with {ENTITIES_SQL}{ISSUES_SQL} select category, severity, count(*) as issues from issues "
    "group by rollup (category, severity)",
)
def audit_issue_counts(spark, sf_dir):
    return A.issue_counts(audit(training(spark, sf_dir)).issues)


@query(
    "audit_issues",
    f"with {ENTITIES_SQL}{ISSUES_SQL} select cast(episode as varchar) as episode, frame, severity, category, metric "
    "from issues",
)
def audit_issues(spark, sf_dir):
    return audit(training(spark, sf_dir)).issues.select("episode", "frame", "severity", "category", "metric")


@query(
    "audit_score",
    f"""with {ENTITIES_SQL}{ISSUES_SQL},
    weights as (select * from (values ('schema', 25e0), ('geometry', 25e0), ('temporal', 15e0), ('image', 15e0),
      ('mask', 10e0), ('redundancy', 8e0), ('labels', 2e0), ('distribution', 0e0)) as v(category, weight)),
    penalty as (select category, sum(case severity when 'error' then 3 when 'warning' then 1 else 0.25e0 end) as p
                from issues group by category),
    score as (select 100 * sum(weight * (1 - least(1e0, coalesce(p, 0) / (select count(*) from frames)))) / sum(weight)
              as score from weights left join penalty using (category))
    select round(score, 6) as score, case when score >= 90 then 'Clean / inspect warnings'
      when score >= 80 then 'Usable with review' when score >= 65 then 'Quality likely affects training'
      else 'Diagnosis recommended before training' end as verdict from score""",
)
def audit_score(spark, sf_dir):
    return audit(training(spark, sf_dir)).score().select(F.round("score", 6).alias("score"), "verdict")


#: The frames with image, mask and hash columns, and the issues of all checks.
SEEN_SQL = f"""with {ENTITIES_SQL}{ISSUES_SQL},
    seen as (select *, value * 3 as b, (event_id % 40) * 1e0 as k, (event_id % 103) * 1e0 as l, (event_id % 80) / 1e1 as e,
      (event_id % 89) / 89e0 as cov, lag((event_id % 89) / 89e0) over (partition by episode order by frame_idx) as cov_before,
      case when frame_idx % 3 <> 1 then h end as hash from frames),
    hashes as (select episode, frame_idx, bit_count(xor(h, lag(h) over (partition by episode order by frame_idx))) as d
      from seen where hash is not null),
    shared as (select hash from seen where hash is not null group by hash having count(distinct episode) > 1),
    every as (
      select episode, severity, category, metric from issues
      union all select episode, 'warning', 'image', unnest(list_filter([
        case when b < 35 or b > 220 then 'brightness' end, case when k < 18 then 'contrast' end,
        case when l < 45 then 'blur_laplacian' end, case when e < 3.5e0 then 'entropy' end], lambda z: z is not null)) from seen
      union all select episode, 'warning', 'mask', 'mask_arm_coverage' from seen where cov <= 0.001e0 or cov >= 0.85e0
      union all select episode, 'warning', 'mask', 'mask_arm_coverage_jump' from seen where abs(cov - cov_before) > 0.2e0
      union all select episode, 'info', 'redundancy', 'dhash_prev_distance' from hashes where d <= 4
      union all select episode, 'info', 'redundancy', 'cross_episode_exact_dhash' from seen where hash in (select hash from shared))"""


def _seen(spark, sf_dir):
    """The training table with image metrics, a mask and sampled hashes."""
    i = F.col("event_id")
    return training(spark, sf_dir).withColumns(
        {
            "brightness": F.col("value") * 3,
            "contrast": (i % 40).cast("double"),
            "blur_laplacian": (i % 103).cast("double"),
            "entropy": (i % 80) / F.lit(10.0),
            "mask_arm_coverage": (i % 89) / F.lit(89.0),
            "dhash": F.when(F.col("frame_idx") % 3 != 1, F.lpad(F.lower(F.hex(F.floor("value").cast("long"))), 16, "0")),
        }
    )


@query("full_audit_issues", f"{SEEN_SQL} select cast(episode as varchar) as episode, severity, category, metric, count(*) as issues from every group by all")
def full_audit_issues(spark, sf_dir):
    issues = audit(_seen(spark, sf_dir)).issues
    return issues.groupBy("episode", "severity", "category", "metric").agg(F.count(F.lit(1)).alias("issues"))


@query(
    "full_audit_score",
    SEEN_SQL
    + """,
    weights as (select * from (values ('schema', 25e0), ('geometry', 25e0), ('temporal', 15e0), ('image', 15e0),
      ('mask', 10e0), ('redundancy', 8e0), ('labels', 2e0), ('distribution', 0e0)) as v(category, weight)),
    penalty as (select category, sum(case severity when 'error' then 3 when 'warning' then 1 else 0.25e0 end) as p from every group by category)
    select round(100 * sum(weight * (1 - least(1e0, coalesce(p, 0) / (select count(*) from frames)))) / sum(weight), 6) as score
    from weights left join penalty using (category)""",
)
def full_audit_score(spark, sf_dir):
    return audit(_seen(spark, sf_dir)).score().select(F.round("score", 6).alias("score"))


@query(
    "full_audit_episodes",
    SEEN_SQL
    + """,
    near as (select episode, count(*) filter (d <= 4) as near from hashes group by episode),
    totals as (select episode, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos from every group by episode)
    select s.episode, count(*) as frames, round(avg(b), 6) as mean_brightness, round(avg(e), 6) as mean_entropy,
      round(avg(l), 6) as mean_blur_laplacian, round(any_value(coalesce(near, 0)) / count(*), 6) as near_duplicate_ratio,
      any_value(coalesce(warnings, 0)) as warnings, any_value(coalesce(infos, 0)) as infos
    from seen s left join near using (episode) left join totals t on t.episode = s.episode group by s.episode""",
)
def full_audit_episodes(spark, sf_dir):
    means = ["mean_brightness", "mean_entropy", "mean_blur_laplacian", "near_duplicate_ratio"]
    out = audit(_seen(spark, sf_dir)).episodes()
    return out.select("episode", "frames", *[F.round(c, 6).alias(c) for c in means], "warnings", "infos")


@query(
    "temporal_metrics",
    f"""with {FRAMES_SQL}{TEMPORAL_SQL} select episode, frame_idx, round(dt, 6) as dt,
        round(med, 6) as episode_median_dt, round(1 / med, 9) as effective_fps from temporal""",
)
def temporal_metrics(spark, sf_dir):
    out = A.temporal_metrics(frames(spark, sf_dir), "ts_us")
    return out.select(
        "episode",
        "frame_idx",
        F.round("dt", 6).alias("dt"),
        F.round("episode_median_dt", 6).alias("episode_median_dt"),
        F.round("effective_fps", 9).alias("effective_fps"),
    )


UNIT_SQL = """, raw as (select *, case episode % 4 when 0 then ts_us * 1e3 when 1 then ts_us * 1e0
                 when 2 then floor(ts_us / 1e3) else floor(ts_us / 1e6) end as ts_raw from frames)"""


@query(
    "time_unit_inference",
    f"""with {FRAMES_SQL}{UNIT_SQL},
    steps as (select episode, abs(ts_raw - lag(ts_raw) over (partition by episode order by frame_idx)) as d from raw)
    select episode, case when median(d) >= 1e7 then 1e-9 when median(d) >= 1e4 then 1e-6
      when median(d) >= 10 then 1e-3 else 1e0 end as scale from steps group by episode""",
)
def time_unit_inference(spark, sf_dir):
    us = F.col("ts_us")
    raw = (
        F.when(F.col("episode") % 4 == 0, us * F.lit(1e3))
        .when(F.col("episode") % 4 == 1, us * F.lit(1.0))
        .when(F.col("episode") % 4 == 2, F.floor(us / F.lit(1e3)).cast("double"))
        .otherwise(F.floor(us / F.lit(1e6)).cast("double"))
    )
    steps = A.time_steps(frames(spark, sf_dir).withColumn("ts_raw", raw), "ts_raw")
    return A.episode_clock(steps).select("episode", "scale")


GAPS_SQL = """, kept as (
  select episode, frame_idx, event_id,
         case when event_id % 211 = 0 then lead(ts_us) over w when lag(event_id % 211) over w = 0 then lag(ts_us) over w
              else ts_us end as ts_us
  from frames where event_id % 11 <> 0 window w as (partition by episode order by frame_idx))"""


@query(
    "temporal_issues_with_gaps",
    f"""with {FRAMES_SQL}{GAPS_SQL},
    steps as (select *, ts_us - lag(ts_us) over w as step, row_number() over w - 1 as pos,
      ts_us - last_value(ts_us ignore nulls) over (partition by episode order by frame_idx
        rows between unbounded preceding and 1 preceding) as vstep
      from kept window w as (partition by episode order by frame_idx)),
    clock as (select episode, median(abs(vstep)) as a, median(case when step > 0 then step end) as m
              from steps group by episode),
    t as (select s.*, step * f as dt, m * f as med from steps s join
      (select episode, m, case when a >= 1e7 then 1e-9 when a >= 1e4 then 1e-6 when a >= 10 then 1e-3 else 1e0 end as f
       from clock) using (episode))
    select cast(episode as varchar) as episode, cast(frame_idx as varchar) as frame,
      case when dt is null or dt <= 0 then 'error' else 'warning' end as severity
    from t where pos > 0 and (dt is null or dt <= 0 or dt > med * 1.8e0)""",
)
def temporal_issues_with_gaps(spark, sf_dir):
    kept = frames(spark, sf_dir).where(F.col("event_id") % 11 != 0)
    moved = S.scan(
        kept,
        ["episode"],
        "frame_idx",
        [S.lead("_next", "ts_us"), S.lag("_prev", F.struct("ts_us", "event_id"))],
    ).withColumn(
        "ts_us",
        F.when(F.col("event_id") % 211 == 0, F.col("_next"))
        .when(F.col("_prev.event_id") % 211 == 0, F.col("_prev.ts_us"))
        .otherwise(F.col("ts_us")),
    )
    return A.temporal_issues(A.temporal_metrics(moved, "ts_us")).select("episode", "frame", "severity")


@query(
    "entity_motion",
    f"""with {ENTITIES_SQL}{MOTION_SQL} select episode, frame_idx, entity, round(step_m, 6) as translation_step,
        round(speed, 8) as speed, round(rot, 4) as rotation_step_deg from valid_motion""",
)
def entity_motion(spark, sf_dir):
    out = audit(training(spark, sf_dir)).motion
    return out.select(
        "episode",
        "frame_idx",
        "entity",
        F.round("translation_step", 6).alias("translation_step"),
        F.round("speed", 8).alias("speed"),
        F.round("rotation_step_deg", 4).alias("rotation_step_deg"),
    )


@query(
    "speed_percentiles",
    f"""with {ENTITIES_SQL}{MOTION_SQL} select episode, entity, round(quantile_cont(speed, 0.95), 8) as p95_speed
        from valid_motion where speed is not null group by episode, entity""",
)
def speed_percentiles(spark, sf_dir):
    out = audit(training(spark, sf_dir)).speeds()
    return out.select("episode", "entity", F.round("p95_speed", 8).alias("p95_speed"))


@query(
    "se3_validation",
    f"""with {ENTITIES_SQL} select episode, frame_idx, entity, ok as finite,
        case when ok then round(sqrt(3) * abs(s * s - 1), 6) end as ortho_err,
        case when ok then round(s * s * s, 6) end as det, case when ok then bottom end as bottom_err from entities""",
)
def se3_validation(spark, sf_dir):
    e = A.with_se3(A.entity_poses(training(spark, sf_dir)))
    return e.select(
        "episode",
        "frame_idx",
        "entity",
        "finite",
        F.round("ortho_err", 6).alias("ortho_err"),
        F.round("det", 6).alias("det"),
        "bottom_err",
    )


@query(
    "hash_distance",
    f"""with {FRAMES_SQL}, sampled as (select episode, frame_idx, h, bit_count(xor(h, lag(h) over
          (partition by episode order by frame_idx))) as d from frames where frame_idx % 3 <> 1)
        select f.episode, f.frame_idx, d as dhash_prev_distance, coalesce(d <= 4, false) as near_duplicate_prev
        from frames f left join sampled using (episode, frame_idx)""",
)
def hash_distance(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn(
        "dhash", F.when(F.col("frame_idx") % 3 != 1, F.lpad(F.lower(F.hex("h")), 16, "0"))
    )
    return A.hash_distance(f).select(
        "episode", "frame_idx", F.col("dhash_prev_distance").cast("int").alias("dhash_prev_distance"), "near_duplicate_prev"
    )


@query(
    "mask_coverage_jumps",
    f"""with {FRAMES_SQL}, c as (select *, (event_id % 89) / 89e0 as cov, lag((event_id % 89) / 89e0)
          over (partition by episode order by frame_idx) as p from frames)
        select cast(episode as varchar) as episode, cast(frame_idx as varchar) as frame, 'mask_arm_coverage_jump' as metric
        from c where abs(cov - p) > 0.2e0""",
)
def mask_coverage_jumps(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("mask_arm_coverage", (F.col("event_id") % 89) / F.lit(89.0))
    return A.mask_jump_issues(f, ["mask_arm_coverage"]).select("episode", "frame", "metric")


@query(
    "mask_fill_issues",
    f"""with {FRAMES_SQL}, c as (select *, (event_id % 89) / 89e0 as cov from frames)
        select cast(episode as varchar) as episode, cast(frame_idx as varchar) as frame,
        case when cov <= 0.001 then 'Mask is nearly empty' else 'Mask covers most of the image' end as message
        from c where cov <= 0.001e0 or cov >= 0.85e0""",
)
def mask_fill_issues(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("mask_arm_coverage", (F.col("event_id") % 89) / F.lit(89.0))
    return A.mask_issues(f, ["mask_arm_coverage"]).select("episode", "frame", "message")


@query(
    "image_threshold_issues",
    f"""with {FRAMES_SQL}, c as (select *, value * 3 as b, (event_id % 40) * 1e0 as k, (event_id % 103) * 1e0 as l,
          (event_id % 80) / 1e1 as e, (event_id % 29) / 1e2 as u, (event_id % 31) / 1e2 as o from frames)
        select cast(episode as varchar) as episode, cast(frame_idx as varchar) as frame, m as metric from (
          select episode, frame_idx, unnest(list_filter([
            case when b < 35 or b > 220 then 'brightness' end, case when k < 18 then 'contrast' end,
            case when l < 45 then 'blur_laplacian' end, case when e < 3.5e0 then 'entropy' end,
            case when u > 0.2e0 then 'underexposed_frac' end, case when o > 0.2e0 then 'overexposed_frac' end],
            lambda z: z is not null)) as m from c)""",
)
def image_threshold_issues(spark, sf_dir):
    i = F.col("event_id")
    f = frames(spark, sf_dir).withColumns(
        {
            "brightness": F.col("value") * 3,
            "contrast": (i % 40).cast("double"),
            "blur_laplacian": (i % 103).cast("double"),
            "entropy": (i % 80) / F.lit(10.0),
            "underexposed_frac": (i % 29) / F.lit(100.0),
            "overexposed_frac": (i % 31) / F.lit(100.0),
        }
    )
    return A.image_issues(f).select("episode", "frame", "metric")


@query(
    "image_size_issues",
    f"""with {FRAMES_SQL} select cast(episode as varchar) as episode, cast(frame_idx as varchar) as frame, metric from (
          select episode, frame_idx, 'image_w' as metric from frames where event_id % 17 = 0
          union all select episode, frame_idx, 'image_h' from frames where event_id % 19 = 0
          union all select episode, frame_idx, 'image_path' from frames where event_id % 23 = 0
          union all select episode, frame_idx, 'image_read' from frames where event_id % 23 <> 0 and event_id % 29 = 0)""",
)
def image_size_issues(spark, sf_dir):
    i = F.col("event_id")
    f = (
        A.flatten_frames(training(spark, sf_dir))
        .withColumn("h", F.col("h_px"))
        .withColumns(
            {
                "image_w": F.when(i % 17 == 0, 641).otherwise(640),
                "image_h": F.when(i % 19 == 0, 481).otherwise(480),
                "image_path": F.when(i % 23 != 0, F.lit("rgb.png")),
                "image_read_ok": i % 29 != 0,
            }
        )
    )
    out = A.record_issues(f).where(F.col("metric").startswith("image"))
    return out.select("episode", "frame", "metric")


DOCS_SQL = "docs as (select source as episode, doc_id as frame_idx, md5(text) as hash from documents)"


@query(
    "exact_duplicates_across_episodes",
    f"""with {DOCS_SQL}, g as (select hash, count(*) as members, count(distinct episode) as episodes from docs
          group by hash having count(distinct episode) > 1)
        select episode, cast(frame_idx as varchar) as frame, hash as value,
          'Same image in ' || members || ' frames of ' || episodes || ' episodes' as message from docs join g using (hash)""",
)
def exact_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("episode"), F.col("doc_id").alias("frame_idx"), F.md5("text").alias("dhash")
    )
    return A.duplicate_issues(d).select("episode", "frame", "value", "message")


@query(
    "train_eval_shift",
    """with d as (select case when label < 5 then 'train' else 'eval' end as split,
             unnest(embedding) as v, generate_subscripts(embedding, 1) as dim from embeddings),
       s as (select dim, avg(v) filter (split = 'train') - avg(v) filter (split = 'eval') as diff,
                    case when stddev_pop(v) < 1e-6 then 1 else stddev_pop(v) end as sd,
                    count(*) filter (split = 'train') as nt, count(*) filter (split = 'eval') as ne from d group by dim)
       select round(sqrt(avg((diff / sd) ** 2)), 6) as mean_shift_rms, max(nt) as train_samples, max(ne) as eval_samples
       from s""",
)
def train_eval_shift(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("split", F.when(F.col("label") < 5, "train").otherwise("eval"))
    out = A.distribution_shift(e, "embedding")
    return out.select(F.round("mean_shift_rms", 6).alias("mean_shift_rms"), "train_samples", "eval_samples")


@query("appearance_pca")
def appearance_pca(spark, sf_dir):
    return A.pca_2d(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(
    "safe_numeric_cast",
    """select event_id, try_cast(json_extract_string(props, '$.k') as double) as k,
              case when event_id % 3 = 0 then try_cast(event_type as double) else value end as v from events""",
)
def safe_numeric_cast(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        A.safe_float(F.get_json_object("props", "$.k")).alias("k"),
        A.safe_float(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))).alias(
            "v"
        ),
    )
