"""Readers of recording files: JSON records per frame, JSON-lines streams, calibration headers.

Each reader has two halves: a scan that yields lines or files, and a parser on columns. The parsers
also work on lines from any other source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.functions.geometry import elements, lit
from framestride.operators import series as S

CORRUPT = "_corrupt_record"
# Layouts of the per-frame records.
_VECTOR, _MATRIX = "array<double>", "array<array<double>>"
_HAND_TYPES = {"confidence": "double", "grasp_state": "int", "joint_angles": "map<string,double>"}
_HAND_TYPES |= {n: _MATRIX for n in ("d2c", "c2w", "kpts_3d", "kpts_2d", "wrist_pose", "palm_pose")}
for _v in ("raw_world", "opt_world"):
    _HAND_TYPES |= {f"{n}_pose_{_v}": _MATRIX for n in ("wrist", "midpoint")}
    _HAND_TYPES |= {f"{n}_{k}_vel_{_v}": _VECTOR for n in ("wrist", "midpoint") for k in ("lin", "ang")}
    _HAND_TYPES |= {f"{n}_translation_{_v}": _VECTOR for n in ("index", "thumb", "midpoint")}
    _HAND_TYPES |= {f"midpoint_orientation_{_v}": _VECTOR, f"distance_midpoint2wrist_{_v}": "double"}
_HAND = f"struct<{','.join(f'{n}:{t}' for n, t in _HAND_TYPES.items())}>"
SCHEMAS = {
    "training": (
        "metadata struct<idx:int,ts:double,w:int,h:int,fps:double,k:array<array<double>>,c2w:array<array<double>>,anchor_key:string,"
        "is_finished:double,world_transforms:struct<cam0:array<array<double>>,virtual_static_anchor:array<array<double>>>>, "
        "obs map<string,string>, "
        "entities struct<hands:map<string,struct<T_hand_to_world:array<array<double>>,grasp:double>>,"
        "objects:map<string,struct<T_obj_to_world:array<array<double>>,is_dynamic:boolean>>>"
    ),
    "camera": "idx int, ts bigint, w int, h int, fps double, k array<array<double>>, d array<double>, c2w array<array<double>>, c2d array<array<double>>, d2w array<array<double>>",
    "hands": f"idx int, ts bigint, hand_r {_HAND}, hand_l {_HAND}",
    "slam": "idx int, ts bigint, t_world array<double>, rpy_deg array<double>, delta_t_world array<double>, delta_rpy_deg array<double>, linear_speed_mps double, angular_speed_rps double, yaw_unwrapped_deg double",
    "phases": "idx int, ts bigint, mode int, stop int, mode_str string, v double, w double",
    "session": "w int, h int, fps double, k array<array<double>>, dual_arm boolean, source_type string, cameras map<string,struct<k:array<array<double>>,w:int,h:int>>",
    "robot": "ts double, is_finished boolean, arms map<string,struct<T_ee_in_cam:array<array<double>>,gripper_q:double,joints:array<double>>>, T_ee_in_cam array<array<double>>, gripper_q double, joints array<double>",
    "tracks": "tracks array<array<array<double>>>, visibility array<array<double>>",
}


def read_records(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """Per-frame JSON files under ``.../<recording>/preprocess/all_data/<frame>/<name>``.

    A file that is not valid JSON keeps its row with ``_corrupt_record`` set.
    """
    schema = f"{SCHEMAS[kind]}, {CORRUPT} string"
    df = (
        spark.read.schema(schema)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name)
        .json(path)
    )
    file = F.col("_metadata.file_path")
    return df.withColumns(
        {
            "episode": F.regexp_extract(file, r"/([^/]+)/preprocess/all_data/[^/]+/[^/]+$", 1),
            "frame": F.regexp_extract(file, r"/all_data/([^/]+)/[^/]+$", 1),
        }
    ).withColumn("frame_idx", F.col("frame").try_cast("int"))


def parse_records(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Records of a text column; an unreadable text keeps its row with ``_corrupt_record`` set."""
    schema = f"{SCHEMAS[kind]}, {CORRUPT} string"
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, parsed.alias("r")).select(*rest, "r.*")


def flat(matrix: Column) -> Column:
    """Row-major list of a nested matrix."""
    return F.flatten(matrix)


def training_table(records: DataFrame) -> DataFrame:
    """The audit's input columns from parsed training records."""
    m, e = F.col("metadata"), F.col("entities")
    hands = F.transform_values(
        e["hands"], lambda k, v: F.struct(flat(v["T_hand_to_world"]).alias("T"), v["grasp"].alias("grasp"))
    )
    objects = F.transform_values(
        e["objects"], lambda k, v: F.struct(flat(v["T_obj_to_world"]).alias("T"), v["is_dynamic"].alias("is_dynamic"))
    )
    return records.select(
        "episode", "frame_idx", m["ts"].alias("ts"), m["w"].alias("w"), m["h"].alias("h"), m["fps"].alias("fps"),
        flat(m["k"]).alias("k"), flat(m["c2w"]).alias("c2w"), m["anchor_key"].alias("anchor_key"),
        m["is_finished"].alias("is_finished"), flat(m["world_transforms"]["cam0"]).alias("cam0"),
        flat(m["world_transforms"]["virtual_static_anchor"]).alias("anchor"), hands.alias("hands"), objects.alias("objects"),
        "obs",
    )


def hand_rows(records: DataFrame) -> DataFrame:
    """One row per hand that a record of kind ``hands`` describes, with all its fields; matrices are flat.

    Unreadable records and absent hands give no row. Keypoints keep their nesting.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("hand")) for s, c in (("right", "hand_r"), ("left", "hand_l"))])
    keep = [c for c in records.columns if c not in ("hand_r", "hand_l", CORRUPT)]
    rows = records.where(F.col(CORRUPT).isNull()).withColumn("_h", F.explode(sides)).where("_h.hand is not null")
    field = lambda n: F.col(f"_h.hand.{n}")
    nested = ("kpts_3d", "kpts_2d")
    fields = [(flat(field(n)) if t == _MATRIX and n not in nested else field(n)).alias(n) for n, t in _HAND_TYPES.items()]
    return rows.select(*keep, F.col("_h.side").alias("side"), *fields)


def robot_arm(side: str) -> Column:
    """State of one arm; a record without ``arms`` describes the right arm only."""
    arm = F.try_element_at("arms", F.lit(side))
    if side != "right":
        return arm
    no_arms = F.col("arms").isNull() | (F.size("arms") == 0)
    return F.coalesce(arm, F.when(no_arms, F.struct("T_ee_in_cam", "gripper_q", "joints")))


def robot_arms(records: DataFrame, sides=("left", "right")) -> DataFrame:
    """One row per arm that a record describes."""
    arms = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), robot_arm(s).alias("arm")) for s in sides]))
    keep = [c for c in records.columns if c not in ("arms", "T_ee_in_cam", "gripper_q", "joints", CORRUPT)]
    rows = records.withColumn("_a", arms).where("_a.arm is not null")
    arm = F.col("_a.arm")
    return rows.select(*keep, F.col("_a.side").alias("side"), flat(arm["T_ee_in_cam"]).alias("T"), arm["gripper_q"].alias("gripper_q"), arm["joints"].alias("joints"))


def session_meta(records: DataFrame) -> DataFrame:
    """One row per robot session with defaults filled in; ``cameras`` always names ``cam0``.

    A camera without own intrinsics or size takes those of the session. An unreadable record is left out.
    """
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)])
    # Size, rate and intrinsics of a session that does not state them.
    own = {"w": F.lit(640), "h": F.lit(480), "fps": F.lit(30.0), "k": eye, "dual_arm": F.lit(False), "source_type": F.lit("unknown")}
    rows = records.where(F.col(CORRUPT).isNull()).withColumns({c: F.coalesce(c, default) for c, default in own.items()})
    camera = lambda c: F.struct(*[F.coalesce(c[n], F.col(n)).alias(n) for n in ("k", "w", "h")])
    named = F.transform_values(F.coalesce("cameras", F.expr("map()").cast(rows.schema["cameras"].dataType)), lambda _, c: camera(c))
    first = F.create_map(F.lit("cam0"), F.struct("k", "w", "h"))
    whole = F.when(F.map_contains_key("_c", "cam0"), F.col("_c")).otherwise(F.map_concat("_c", first))
    return rows.withColumn("_c", named).select("episode", *own, whole.alias("cameras"))


def object_tracks(records: DataFrame) -> DataFrame:
    """Long tracks of one object; the longer of the two first axes is time."""
    d0, d1 = F.size("tracks"), F.size(F.get("tracks", F.lit(0)))
    rows = records.withColumn("_time_first", d0 > d1)
    keep = [c for c in records.columns if c not in ("tracks", "visibility", CORRUPT)]
    a = rows.select(*keep, "_time_first", "visibility", F.posexplode("tracks").alias("_i", "_row"))
    b = a.select(*keep, "_time_first", "visibility", "_i", F.posexplode("_row").alias("_j", "_p"))
    vis = F.get(F.get("visibility", F.col("_i")), F.col("_j"))
    return b.select(
        *keep,
        F.when(F.col("_time_first"), F.col("_i")).otherwise(F.col("_j")).alias("frame_idx"),
        F.when(F.col("_time_first"), F.col("_j")).otherwise(F.col("_i")).alias("kpt"),
        F.get("_p", F.lit(0)).alias("u"), F.get("_p", F.lit(1)).alias("v"), vis.alias("vis"),
    )


def object_geometry(spark: SparkSession, lines: DataFrame, column: str = "value", anchor: str | None = None) -> DataFrame:
    """Objects of a recording from one JSON text; the anchor is the first name or the configured one."""
    schema = "map<string,struct<points_world:array<array<double>>,points_cam0:array<array<double>>,object_to_cam0:array<array<double>>>>"
    rows = lines.select("episode", F.from_json(column, schema).alias("m"))
    long = rows.select("episode", F.explode("m").alias("obj", "o")).where(F.col("obj").startswith("obj"))
    out = long.select("episode", "obj", "o.points_world", "o.points_cam0", flat(F.col("o.object_to_cam0")).alias("object_to_cam0"))
    first = out.groupBy("episode").agg(F.min("obj").alias("_first"), F.bool_or(F.col("obj") == (anchor or "")).alias("_has"))
    if anchor is None:
        key = F.col("_first")
    else:
        key = F.when(F.col("_has"), F.lit(anchor)).otherwise(F.raise_error(F.lit(f"unknown anchor: {anchor}")))
    return out.join(first, "episode").withColumn("anchor_key", key).drop("_first", "_has")


# --- streams -------------------------------------------------------------------------------------------

_JOINT = "struct<p:string,s:bigint,r:double>"
_HANDS = f"struct<isActive:boolean,scale:double,HandJointLocations:array<{_JOINT}>>"
TRACKING_LINE = (
    "notice string, timeStampNs bigint, cameraIntrinsics array<double>, cameraExtrinsics string, "
    f"Head struct<pose:string,status:bigint,timeStampNs:bigint>, Hand struct<leftHand:{_HANDS},rightHand:{_HANDS}>"
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and byte order."""
    return spark.read.text(path).withColumns(
        {"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()}
    )


def pose7(text: Column) -> Column:
    """``x,y,z,qx,qy,qz,qw`` as seven numbers; null when it is not exactly that."""
    parts = F.split(text, ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 7) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(ok, numbers)


def parse_tracking(lines: DataFrame, column: str = "value", joints: int = 26) -> DataFrame:
    """Header and data rows of a tracking stream.

    ``row_kind`` is ``header`` for the row with a notice, ``data`` for rows with head and hands; others
    are skipped. Hands without exactly ``joints`` joints are marked invalid.
    """
    rest = [c for c in lines.columns if c != column]
    rows = lines.select(*rest, F.from_json(column, TRACKING_LINE).alias("r"))
    header = F.col("r.notice").isNotNull()
    data = F.col("r.Head").isNotNull() & F.col("r.Hand").isNotNull()

    def hand(side: str) -> Column:
        h = F.col(f"r.Hand.{side}Hand")
        points = F.transform(
            h["HandJointLocations"],
            lambda j: F.struct(pose7(j["p"]).alias("pose"), j["s"].alias("status"), j["r"].alias("radius")),
        )
        valid = F.size(points) == joints
        return F.when(
            h.isNotNull(),
            F.struct(h["isActive"].alias("is_active"), h["scale"].alias("scale"), points.alias("joints"), valid.alias("valid")),
        )

    return rows.where(header | data).select(
        *rest,
        F.when(header, "header").otherwise("data").alias("row_kind"),
        F.coalesce("r.Head.timeStampNs", "r.timeStampNs").alias("timestamp_ns"),
        pose7(F.col("r.Head.pose")).alias("head"),
        F.col("r.Head.status").alias("head_status"),
        hand("left").alias("left"),
        hand("right").alias("right"),
        F.when(header, F.col("r.cameraIntrinsics")).alias("intrinsics"),
        F.when(header, F.col("r.cameraExtrinsics")).alias("extrinsics"),
    )


def parse_video_pts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Frame index and presentation time of each line."""
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.from_json(column, "frame_index bigint, pts_seconds double").alias("r")).select(*rest, "r.*")


def order_errors(rows: DataFrame, value: str, order: str, strict: bool = True, keys=("episode",)) -> DataFrame:
    """Rows whose value does not increase (strictly) in stream order."""
    out = S.scan(rows, list(keys), order, [S.lag("_p", value)])
    bad = (F.col(value) <= F.col("_p")) if strict else (F.col(value) < F.col("_p"))
    return out.where(bad).drop("_p")


def parse_calibration(rows: DataFrame, intrinsics: str = "intrinsics", extrinsics: str = "extrinsics") -> DataFrame:
    """Camera matrix and the two mounting poses of a header.

    Intrinsics are ``cx, cy, fx, fy``. Extrinsics are two 4x4 matrices joined by ``|``, a 2x4x4 array
    or 32 numbers; the first is the right eye, the second the left.
    """
    k = elements(intrinsics, 4)
    text = F.regexp_replace(F.col(extrinsics), r"[\[\]\s]", "")
    numbers = F.filter(
        F.transform(F.split(F.regexp_replace(text, r"\|", ","), ","), lambda p: p.try_cast("double")), lambda n: n.isNotNull()
    )
    finite = lambda a: F.forall(a, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != lit(float("inf"))))
    ok = (F.size(intrinsics) == 4) & finite(F.col(intrinsics)) & (F.size("_n") == 32) & finite(F.col("_n"))
    zero, one = lit(0), lit(1)
    return (
        rows.withColumn("_n", numbers)
        .withColumn("valid", F.coalesce(ok, F.lit(False)))
        .withColumns(
            {
                "k": F.when(F.col("valid"), F.array(k[2], zero, k[0], zero, k[3], k[1], zero, zero, one)),
                "e_right": F.when(F.col("valid"), F.slice("_n", 1, 16)),
                "e_left": F.when(F.col("valid"), F.slice("_n", 17, 16)),
            }
        )
        .drop("_n")
    )


def parse_eye_hands(lines: DataFrame, column: str = "value") -> DataFrame:
    """Detections per frame and eye, one row per hand."""
    schema = "struct<pts_seconds:double,crop_width:int,hands:array<struct<side:string,score:double,uv:array<array<double>>>>>"
    rest = [c for c in lines.columns if c != column]
    rows = lines.select(*rest, F.from_json(column, schema).alias("r"))
    return rows.select(*rest, "r.pts_seconds", "r.crop_width", F.posexplode_outer("r.hands").alias("hand_id", "h")).select(
        *rest, "pts_seconds", "crop_width", "hand_id", "h.side", "h.score", "h.uv"
    )


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results from a tab-separated file with a header."""
    text = "experiment_id parent_experiment timestamp git_commit hypothesis changed_parameters".split()
    schema = (
        ", ".join(f"{c} string" for c in text)
        + ", seed int, budget_level string, epochs int, runtime_seconds double, pos_err_w_m double, rot_err_w_deg double, "
        "grasp_f1_w double, score double, status string, decision string, notes string"
    )
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation snapshots ``<path>/<experiment>/eval_snapshots/eval_ep_*.json``, one row per file."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "eval_ep_*.json")
    place = r"([^/]+)/eval_snapshots/([^/]+)$"
    lines = reader.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), place, 1).alias("experiment_id"),
        F.regexp_extract(F.col("_metadata.file_path"), place, 2).alias("file_name"), "value",
    )
    return parse_snapshots(lines.where("experiment_id <> ''"))


def parse_snapshots(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metrics of snapshot texts as strings, null where the key is missing; ``ok`` is false for unreadable texts."""
    rest = [c for c in lines.columns if c != column]
    names = ("pos_err_w_m", "rot_err_w_deg", "grasp_f1_w")
    rows = lines.withColumn("_m", F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"}))
    # Numbers that are not finite come quoted out of the parser.
    text = lambda n: F.regexp_replace(F.try_element_at("_m", F.lit(n)), '^"(NaN|-?Infinity)"$', "$1")
    return rows.select(*rest, F.col("_m").isNotNull().alias("ok"), *[text(n).alias(n) for n in names])


def read_images(spark: SparkSession, path: str, decode, pattern: str = "*.png") -> DataFrame:
    """Luma rows of image files through a caller's decoder ``bytes -> (h, w) uint8 array``.

    A file the decoder rejects keeps its row with ``image_read_ok = false``. Spark does not list files of length 0;
    the record check finds those frames by their missing image.
    """
    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    a = np.asarray(decode(content))
                    out.append((name, True, a.astype(int).ravel(), a.shape[1], a.shape[0]))
                except Exception:  # an undecodable image is an issue row, not a failed job
                    out.append((name, False, None, None, None))
            yield pd.DataFrame(out, columns=["path", "image_read_ok", "luma", "w", "h"])

    return files.select("path", "content").mapInPandas(run, "path string, image_read_ok boolean, luma array<int>, w int, h int")
