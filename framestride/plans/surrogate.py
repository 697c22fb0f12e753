"""Frame tables derived from the driver's tables (formulas in ``FIXTURES.md``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.functions import geometry as G
from framestride.operators import series as S
from framestride.operators.bounds import dealt, fits, measure
from framestride.session import chunk_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str = "ts"):
    """Microseconds since the epoch of a timestamp without a zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames: a user is a recording, ordered by time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode"), "event_id", micros().alias("ts_us"), "event_type", "value"
    )
    e = measure(e, "episode")
    if fits(e, ["episode"], chunk_rows(e)):
        e = dealt(e, ["episode"])
    else:
        e = S.chunk_hot(e, ["episode"], "ts_us", chunk_rows(e))
    out = S.scan(
        e,
        ["episode"],
        ["ts_us", "event_id"],
        [S.position("frame_idx"), S.total("n_frames", F.count(F.lit(1)))],
        chunked=True,
    ).drop(S.CHUNK)
    idx = F.col("event_id")
    return out.select(
        "episode",
        "frame_idx",
        "n_frames",
        "ts_us",
        "event_id",
        "event_type",
        "value",
        F.when(F.col("episode") % 5 == 0, "eval").otherwise("train").alias("split"),
        (F.col("value") / 100).alias("x"),
        ((idx % 97) / F.lit(97.0)).alias("y"),
        (F.col("frame_idx") / F.lit(100.0)).alias("z"),
        F.when(idx % 7 != 0, F.col("value") * 7).alias("yaw_deg"),
        F.floor("value").cast("long").alias("h"),
        F.col("event_type").isin("click", "purchase").alias("grasp"),
        (F.col("frame_idx") == F.col("n_frames") - 1).alias("is_last"),
    )


#: The same frames for the oracle, as a common table expression.
FRAMES_SQL = """
frames as (
  select user_id as episode, frame_idx, n_frames, ts_us, event_id, event_type, value,
         case when user_id % 5 = 0 then 'eval' else 'train' end as split,
         value / 100 as x, (event_id % 97) / 97e0 as y, frame_idx / 1e2 as z,
         case when event_id % 7 <> 0 then value * 7 end as yaw_deg,
         cast(floor(value) as bigint) as h,
         event_type in ('click', 'purchase') as grasp,
         frame_idx = n_frames - 1 as is_last
  from (select *, epoch_us(ts) as ts_us,
               row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx,
               count(*) over (partition by user_id) as n_frames
        from events)
)"""


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with camera, hand and object poses; some are broken on purpose."""
    f = frames(spark, sf_dir)
    idx = F.col("event_id")
    zero, one = F.lit(0.0), F.lit(1.0)
    r = G.rotation_z(F.radians("yaw_deg"))
    factor = F.when(idx % 101 == 0, F.lit(1.1)).otherwise(one)
    m = G.from_parts([x * factor for x in r], [F.col("x"), F.col("y"), F.col("z")])
    m[15] = F.when(idx % 103 == 0, F.lit(2.0)).otherwise(one)
    hand = G.from_parts(
        G.rotation_z(F.radians(F.col("value") * 3)), [F.col("x") + F.lit(0.01), F.col("y"), F.col("z")]
    )
    obj = G.from_parts(G.rotation_z(zero), [(idx % 5) / F.lit(50.0), zero, zero])
    record = "struct<T:array<double>,grasp:double>"
    hands = F.when(
        idx % 7 != 0,
        F.create_map(F.lit("right"), F.struct(F.array(*hand).alias("T"), F.col("grasp").cast("double").alias("grasp"))),
    ).otherwise(F.expr(f"cast(map() as map<string,{record}>)"))
    objects = F.create_map(F.lit("obj1"), F.struct(F.array(*obj).alias("T"), F.lit(False).alias("is_dynamic")))
    k = [700.0, 0.0, 320.0, 0.0, 700.0, 240.0, 0.0, 0.0, 1.0]
    return f.select(
        "*",
        F.col("ts_us").alias("ts"),
        F.lit(640).alias("w"),
        F.lit(480).alias("h_px"),
        F.when(idx % 109 != 0, F.array(*[F.lit(v) for v in k])).alias("k"),
        F.when(F.col("yaw_deg").isNotNull(), F.array(*m)).alias("c2w"),
        F.when((F.col("episode") % 10 == 3) & (F.col("frame_idx") % 2 == 1), "obj2").otherwise("obj1").alias(
            "anchor_key"
        ),
        (F.col("is_last") & (F.col("episode") % 3 == 0)).cast("double").alias("is_finished"),
        hands.alias("hands"),
        objects.alias("objects"),
    )


#: Long entity poses for the oracle: angle about z, position, and the two kinds of damage.
ENTITIES_SQL = FRAMES_SQL + """,
entities as (
  select episode, frame_idx, ts_us, event_id, 'camera' as entity, 'camera' as kind, yaw_deg is not null as ok,
         radians(yaw_deg) as a, x as px, y as py, z as pz,
         case when event_id % 101 = 0 then 1.1e0 else 1e0 end as s,
         case when event_id % 103 = 0 then 1e0 else 0e0 end as bottom, cast(null as double) as grasp
  from frames
  union all
  select episode, frame_idx, ts_us, event_id, 'hand_right', 'hand', true, radians(value * 3),
         x + 0.01e0, y, z, 1e0, 0e0, case when grasp then 1e0 else 0e0 end
  from frames where event_id % 7 <> 0
  union all
  select episode, frame_idx, ts_us, event_id, 'object_obj1', 'object', true, 0e0,
         (event_id % 5) / 50e0, 0e0, 0e0, 1e0, 0e0, null
  from frames
)"""
