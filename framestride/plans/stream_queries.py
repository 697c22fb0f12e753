"""Registered streaming queries: the surrogate frames arrive as files, every stream is run until its input is used up."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.operators import audit as audit_operators
from framestride.plans.audit_queries import ISSUES_SQL
from framestride.plans.hand_queries import side, turning
from framestride.plans.object_queries import latch_inputs
from framestride.plans.registry import ORACLES, query
from framestride.plans.series_queries import SYNC_SQL
from framestride.plans.surrogate import ENTITIES_SQL, FRAMES_SQL, frames, training
from framestride.session import checkpoint_dir, stage
from framestride.streaming import jobs


#: Slices of a played stream, and files of a slice; one slice is one micro-batch.
SLICES, FILES = 4, 4


def played(parts: list[tuple[DataFrame, str]], job: Callable[..., DataFrame], last: list[DataFrame] | None = None) -> DataFrame:
    """Run ``job`` over streams of the given rows, played in ``SLICES`` micro-batches in ascending order of a column.

    All parts are cut at the same values. ``last`` is played after the rows. Returns what the job put out.
    """
    spark = parts[0][0].sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/framestride-stream-{uuid.uuid4().hex}"
    # Each part is read once for its span and once per slice.
    parts = [(stage(rows), order) for rows, order in parts]
    spans = [rows.agg(F.min(order), F.max(order)).first() for rows, order in parts]
    low, high = min(s[0] for s in spans), max(s[1] for s in spans)
    streams = []
    for k, (rows, order) in enumerate(parts):
        cut = F.floor((F.col(order) - low) * F.lit(SLICES) / F.lit(high - low + 1))
        for n in range(SLICES):
            rows.where(cut == n).drop("_play").repartition(FILES).write.mode("append").parquet(f"{root}/in{k}")
        if last is not None:
            last[k].coalesce(1).write.mode("append").parquet(f"{root}/in{k}")
        stream = spark.readStream.schema(rows.drop("_play").schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/in{k}")
        streams.append(stream)
    out = job(*streams)
    writer = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _time(us: str):
    return F.timestamp_micros(F.col(us))


@query("streaming_distinct_frames", f"with {FRAMES_SQL} select episode, frame_idx, event_id from frames")
def streaming_distinct_frames(spark, sf_dir):
    rows = frames(spark, sf_dir).select("episode", "frame_idx", "event_id", _time("ts_us").alias("ts"), F.col("ts_us").alias("_play"))
    again = rows.where("event_id % 4 = 0")
    return played([(rows.union(again), "_play")], jobs.distinct_frames).select("episode", "frame_idx", "event_id")


@query("streaming_grasp_hysteresis", ORACLES["grasp_hysteresis"])
def streaming_grasp_hysteresis(spark, sf_dir):
    jobs.configure(spark)
    rows = side(spark, sf_dir).select("episode", "side", "frame_idx", "ratio")
    return played([(rows, "frame_idx")], jobs.grasp_hysteresis).select("episode", "frame_idx", "grasp_state")


@query(
    "streaming_nearest_sync",
    SYNC_SQL + """ select episode, frame_idx, case when within_tolerance then tracking_index end as tracking_index,
      case when within_tolerance then delta end as delta, within_tolerance from synced""",
)
def streaming_nearest_sync(spark, sf_dir):
    jobs.configure(spark)
    f = frames(spark, sf_dir)
    at, play = _time("ts_us"), F.col("ts_us").alias("_play")
    video = f.where("event_id % 3 = 0").select("episode", "frame_idx", at.alias("ts"), play)
    track = f.where("event_id % 3 <> 0").select("episode", F.col("frame_idx").alias("tracking_index"), at.alias("tracking_ts"), play)
    last = [jobs.closing(video.drop("_play"), "frame_idx", "ts", "30 days"), jobs.closing(track.drop("_play"), "tracking_index", "tracking_ts", "30 days")]
    out = played([(video, "_play"), (track, "_play")], lambda v, t: jobs.synchronise(v, t, 3_600_000_000, "1 hour"), last)
    return out.select("episode", "frame_idx", "tracking_index", F.col("delta_us").alias("delta"), "within_tolerance")


def _entities(spark, sf_dir):
    rows = audit_operators.entity_poses(training(spark, sf_dir).withColumn("ts_s", F.col("ts_us") * F.lit(1e-9)), ["ts_s"])
    return rows.select("episode", "entity", "kind", F.col("frame_idx").alias("pos"), "ts_s", "T")


@query("streaming_entity_motion", ORACLES["entity_motion"])
def streaming_entity_motion(spark, sf_dir):
    jobs.configure(spark)
    out = played([(_entities(spark, sf_dir), "pos")], jobs.entity_motion)
    rounded = {"translation_step": 6, "speed": 8, "rotation_step_deg": 4}
    return out.select("episode", F.col("pos").alias("frame_idx"), "entity", *[F.round(c, n).alias(c) for c, n in rounded.items()])


#: The declared frame period of the surrogate frames, in the unit that the batch audit infers for them (times a billionth).
PERIOD = 12


@query(
    "streaming_motion_audit",
    f"""with {ENTITIES_SQL}{ISSUES_SQL}
    select cast(episode as varchar) as episode, frame, severity, category, metric from issues where category = 'trajectory'
    union all
    select cast(episode as varchar), cast(frame_idx as varchar), case when dt > 0 then 'warning' else 'error' end, 'temporal', 'dt'
    from temporal where frame_idx > 0 and (dt is null or dt <= 0 or dt > {PERIOD} * 1.8e0)""",
)
def streaming_motion_audit(spark, sf_dir):
    jobs.configure(spark)
    out = played([(_entities(spark, sf_dir), "pos")], lambda s: jobs.motion_audit(s, PERIOD))
    return out.select("episode", "frame", "severity", "category", "metric")


@query("streaming_latch")
def streaming_latch(spark, sf_dir):
    jobs.configure(spark)
    hands, objects, anchors = latch_inputs(spark, sf_dir)
    first = objects.join(anchors, "episode").select("episode", F.lit(-1).cast("long").alias("frame_idx"), "obj", "T", (F.col("obj") == F.col("anchor_key")).alias("is_anchor"))
    rows = hands.withColumnRenamed("pos", "frame_idx").unionByName(first, allowMissingColumns=True)
    out = played([(rows, "frame_idx")], jobs.latch)
    return out.select("episode", "frame_idx", "obj", F.transform("T", lambda v: F.round(v, 6)).alias("T"))


@query("streaming_command_smoothing")
def streaming_command_smoothing(spark, sf_dir):
    jobs.configure(spark)
    rows = turning(spark, sf_dir).select("episode", "side", "frame_idx", "T")
    out = played([(rows, "frame_idx")], jobs.command_smoothing)
    return out.select("episode", "frame_idx", F.transform("command", lambda v: F.round(v, 6)).alias("command"))
