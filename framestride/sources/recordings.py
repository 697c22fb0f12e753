"""Discovery of recordings, frames and artefacts from a file listing.

A listing has ``path`` and ``size``; :func:`list_files` makes one without reading file contents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FRAME_DIR = r"^(.*)/preprocess/all_data/"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every file below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"))


def discover_sessions(files: DataFrame, task: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Recordings of a task with a ``preprocess/all_data`` folder, in both layouts.

    ``<task>/<source>/<recording>`` and ``<task>/<recording>``; without duplicates.
    """
    root = F.regexp_extract("path", _FRAME_DIR, 1)
    tail = F.regexp_extract(root, rf"(?:^|/){task}/(.+)$", 1)
    parts = F.split(tail, "/")
    rows = files.select(root.alias("root"), parts.alias("p"), tail.alias("t")).where((F.col("root") != "") & (F.col("t") != ""))
    nested = rows.where(F.size("p") == 2).select("root", F.get("p", F.lit(0)).alias("source"), F.get("p", F.lit(1)).alias("episode"))
    plain = rows.where(F.size("p") == 1).select("root", F.lit(None).cast("string").alias("source"), F.get("p", F.lit(0)).alias("episode"))
    if sources is not None:
        nested, plain = nested.where(F.col("source").isin(*sources)), plain.limit(0)
    return nested.unionByName(plain).distinct()


def session_number(name: Column, pattern: str = r"^mps_.*_(\d+)_vrs$") -> Column:
    """Number in a recording name, null when the name does not match."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).cast("int"))


ROBOT_NAME = r"^(?:teleop|teaching)_.*_(\d+)$"


def numbered_sessions(names: DataFrame, first: int | None = None, last: int | None = None, pattern: str | None = None) -> DataFrame:
    """Matching recordings in numeric order, optionally an inclusive range, open on either side."""
    number = session_number(F.col("episode"), pattern) if pattern else session_number(F.col("episode"))
    rows = names.withColumn("session_index", number).where("session_index is not null")
    if first is not None:
        rows = rows.where(F.col("session_index") >= first)
    if last is not None:
        rows = rows.where(F.col("session_index") <= last)
    return rows.orderBy("session_index")


def discover_frames(files: DataFrame) -> DataFrame:
    """Frame folders of each recording; numeric names first by value, then the others."""
    frame = F.regexp_extract("path", r"/all_data/([^/]+)/", 1)
    episode = F.regexp_extract("path", r"/([^/]+)/preprocess/all_data/", 1)
    rows = files.select(episode.alias("episode"), frame.alias("frame")).where("frame <> ''").distinct()
    return rows.withColumn("frame_idx", F.col("frame").try_cast("int"))


def frame_order() -> list[Column]:
    """Sort columns of frame folders."""
    return [F.col("frame_idx").isNull(), F.col("frame_idx"), F.col("frame")]


def choose_image(frames: DataFrame, files: DataFrame, requested: str | None, obs: Sequence[str], fallbacks: Sequence[str]) -> DataFrame:
    """Image of each frame: the requested name, then the record's paths, then fixed names.

    ``frames`` has ``frame_dir`` and the ``obs`` map; a candidate counts only if it is in the listing.
    """
    joined = lambda name: F.concat_ws("/", "frame_dir", F.lit(name))
    candidates = ([joined(requested)] if requested else []) + [F.col("obs")[k] for k in obs] + [joined(n) for n in fallbacks]
    ranked = frames.select("episode", "frame_idx", F.posexplode(F.array(*candidates)).alias("rank", "path")).where("path is not null")
    found = ranked.join(files.select("path").distinct(), "path", "left_semi")
    best = found.groupBy("episode", "frame_idx").agg(F.min_by("path", "rank").alias("image_path"))
    return frames.join(best, ["episode", "frame_idx"], "left")


def missing_files(sessions: DataFrame, files: DataFrame, required: dict[str, Sequence[str]], features: Sequence[str]) -> DataFrame:
    """Required files that a recording lacks, for the enabled features.

    ``required`` maps a feature to relative paths; ``files`` has ``episode`` and ``relative``.
    """
    names = [p for f in features for p in required.get(f, ())]
    wanted = sessions.select("episode", F.explode(F.array(*[F.lit(n) for n in names])).alias("relative"))
    return wanted.join(files.select("episode", "relative"), ["episode", "relative"], "left_anti")


def inventory(files: DataFrame, exclude_derived: bool = False) -> DataFrame:
    """Files and bytes per recording; derived files are those below ``preprocess``."""
    rows = files.where(~F.col("relative").startswith("preprocess/")) if exclude_derived else files
    return rows.groupBy("episode").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def first_open_stage(recordings: DataFrame, artefacts: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Finished stages per recording and the first unfinished one in order.

    ``artefacts`` has ``episode`` and ``stage`` for each artefact that exists; a recording without any starts at the
    first stage.
    """
    done = {s: F.max((F.col("stage") == s).cast("int")) for s in stages}
    flags = artefacts.groupBy("episode").agg(*[c.alias(s) for s, c in done.items()])
    flags = recordings.select("episode").distinct().join(flags, "episode", "left").fillna(0, list(stages))
    open_ = F.coalesce(*[F.when(F.col(s) == 0, F.lit(s)) for s in stages])
    return flags.select(
        "episode", F.array_compact(F.array(*[F.when(F.col(s) == 1, F.lit(s)) for s in stages])).alias("completed"), open_.alias("start")
    )
