"""Training-table assembly: joins of the per-frame tables, splits, labels, samples (J02, P*, K03)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestride.operators import series as S
from framestride.session import chunk_rows

KEY = ["episode", "frame_idx"]


def join_frames(cameras: DataFrame, hands: DataFrame, phases: DataFrame, slam: DataFrame) -> DataFrame:
    """Frames that have all four records."""
    return cameras.join(hands, KEY).join(phases, KEY).join(slam, KEY)


def frame_counters(frames: DataFrame, tables: dict[str, DataFrame], hand_flag: str = "has_hand") -> DataFrame:
    """Total, valid, missing-file and no-hand frames per recording.

    ``tables['hands']`` has ``has_hand``; the counts come from one presence table.
    """
    out = frames.select(*KEY)
    for name, t in tables.items():
        extra = [F.col(hand_flag)] if name == "hands" else []
        out = out.join(t.select(*KEY, *extra, F.lit(True).alias(f"_{name}")), KEY, "left")
    complete = F.lit(True)
    for name in tables:
        complete = complete & F.coalesce(F.col(f"_{name}"), F.lit(False))
    seen = F.coalesce(F.col(hand_flag), F.lit(False))
    return out.groupBy("episode").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(complete).alias("valid"),
        F.count_if(~complete).alias("discarded_missing_file"),
        F.count_if(complete & ~seen).alias("discarded_no_hand"),
    )


def trainable(training: DataFrame, side: str = "right", hands: str = "hands", image: str | None = None) -> DataFrame:
    """Frames with the chosen hand, and optionally with the chosen image path."""
    has = F.coalesce(F.array_contains(F.map_keys(hands), side), F.lit(False))
    if image is not None:
        has = has & F.col("obs")[image].isNotNull()
    return training.where(has)


def sample_index(training: DataFrame, side: str = "right", hands: str = "hands") -> DataFrame:
    """Trainable frames numbered by recording and frame.

    The number is the rank in the recording plus the rows of the recordings before it; the latter is
    a running sum over one row per recording.
    """
    rows = S.scan(trainable(training, side, hands).select(*KEY), ["episode"], "frame_idx", [S.position("_in")])
    sizes = rows.groupBy("episode").agg(F.count(F.lit(1)).alias("_n"))
    # One row per recording, not per frame, meets in this window.
    before = F.sum("_n").over(Window.orderBy("episode").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("episode", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, "episode").select(*KEY, (F.col("_before") + F.col("_in")).alias("sample_id"))


def split_label(episode: Column, pattern: str = "*_000_vrs") -> Column:
    """``eval`` for recordings whose name matches the glob, else ``train``."""
    regex = "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".^$+{}[]|()\\" else c) for c in pattern) + "$"
    return F.when(episode.rlike(regex), "eval").otherwise("train")


def session_split(sessions: DataFrame, counts: dict[str, int], eval_source: str) -> DataFrame:
    """The first session of the evaluation source is held out, the next ones train.

    Without the wanted source the first active one is used. Counts are clamped to what exists.
    """
    active = [s for s, n in counts.items() if int(n) > 0]
    if eval_source not in active:
        eval_source = active[0] if active else ""
    table = sessions.sparkSession.createDataFrame([(s, int(counts[s])) for s in active], "source string, _count int")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("session_index")) - 1
    rows = sessions.withColumn("_rank", rank).join(F.broadcast(table), "source")
    held = (F.col("source") == eval_source) & (F.col("_rank") == 0)
    shift = F.when(F.col("source") == eval_source, 1).otherwise(0)
    chosen = F.when(held, "eval").when(F.col("_rank") - shift < F.col("_count"), "train")
    return rows.withColumn("split", chosen).where("split is not null").drop("_rank", "_count")


def apply_split_manifest(sessions: DataFrame, manifest: dict[str, Sequence[str]]) -> DataFrame:
    """Split from an explicit list of recordings; recordings that are not listed are dropped."""
    rows = [(e, s) for s, names in manifest.items() for e in names]
    if len({e for e, _ in rows}) != len(rows):
        raise ValueError("a recording is listed twice")
    table = sessions.sparkSession.createDataFrame(rows, "episode string, split string")
    return sessions.drop("split").join(table, "episode")


def finished_by_mode(mode: Column) -> Column:
    """Finished label of phase mode 4."""
    return F.when(mode == 4, 1.0).otherwise(0.0)


def finished_by_tail(frames: DataFrame, last: int = 30, flag: str | None = "flag") -> DataFrame:
    """Recorded flag where there is one, else the last ``last`` frames of the recording."""
    out = S.scan(frames, ["episode"], "frame_idx", [S.position("_p"), S.total("_n", F.count(F.lit(1)))])
    tail = (F.col("_p") >= F.col("_n") - last).cast("double")
    value = F.coalesce(F.col(flag).cast("double"), tail) if flag else tail
    return out.withColumn("is_finished", value).drop("_p", "_n")


def sample_positions(frames: DataFrame, every: int, cap: int | None = None) -> DataFrame:
    """Every ``every``-th frame position, and only the first ``cap`` positions."""
    out = S.densify(frames, ["episode"], "frame_idx", "_p")
    keep = F.col("_p") < cap if cap is not None else F.lit(True)
    return out.where(keep).withColumn("sampled", F.col("_p") % every == 0).drop("_p")


def observation_path(root: Column, *parts: Column) -> Column:
    """Path of an observation with single slashes."""
    return F.regexp_replace(F.concat_ws("/", root, *parts), "/{2,}", "/")


def write_training(training: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training table as Parquet partitioned by task and recording (K03): one file per chunk of frames of a recording."""
    chunk = F.floor(F.col("frame_idx") / chunk_rows(training))
    training.repartition("task", "episode", chunk).write.mode(mode).partitionBy("task", "episode").parquet(path)
