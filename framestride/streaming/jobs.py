"""Structured Streaming forms of the per-frame state machines.

State is kept with ``transformWithStateInPandas``: for each recording (and side) a previous pose and time, a few counters,
or one latch per hand. The series are dealt to ``BUCKETS`` buckets and a bucket's states are one value, so a micro-batch
costs a call per bucket and not one per series. Within a micro-batch the rows of a key are
processed in frame order; a frame at or before the last one seen is dropped, as in the batch scans. The source's trigger
(``maxFilesPerTrigger`` and the like) bounds the rows of a micro-batch, and with it what a task holds of one recording.
The state store needs the RocksDB provider (:func:`configure`). With ``expire_ms`` the state of a silent
recording is dropped after that processing time; leave it out for ``availableNow`` runs, which would wait
for the timers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from framestride.functions.issues import explode_checks
from framestride.operators import audit
from framestride.operators.folds import Hysteresis, command_steps
from framestride.operators.latch import reference_step

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """Use the state store that the stateful operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


#: Buckets of series; each is one key of the state store.
BUCKETS = 1024


class _Fold(StatefulProcessor):
    """The states of a bucket's series as one value, and a step over their ordered rows.

    ``fold(keys, states, rows, code)`` gets the key and the state (or None) of each series and its rows in order, where
    ``code`` numbers the series of each row; it returns the states after them and the rows put out.
    """

    order: Sequence[str] = ("frame_idx",)
    keys: Sequence[str] = ()
    expire_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("states", "states binary")

    def _read(self) -> dict:
        return pickle.loads(bytes(self.cell.get()[0])) if self.cell.exists() else {}

    def _write(self, states: dict) -> None:
        """States are built-in values by key, each with the time it was last seen."""
        if states:
            self.cell.update((pickle.dumps(states),))
        else:
            self.cell.clear()
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if states:
                self.handle.registerTimer(min(seen for seen, _ in states.values()) + self.expire_ms)

    def _current(self, timerValues) -> tuple[dict, int]:
        """The states that have not expired, and the time."""
        states = self._read()
        if self.expire_ms is None:
            return states, 0
        now = timerValues.getCurrentProcessingTimeInMs()
        return {k: v for k, v in states.items() if v[0] + self.expire_ms > now}, now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One bucket's rows of one micro-batch; the trigger bounds their number.
        pdf = pd.concat(list(rows), ignore_index=True)
        code = pdf.groupby(list(self.keys), dropna=False, sort=False).ngroup().to_numpy()
        by_order = np.lexsort([pdf[c].rank(method="dense").fillna(0).to_numpy() for c in reversed(self.order)] + [code])
        pdf, code = pdf.iloc[by_order].reset_index(drop=True), code[by_order]
        firsts = np.flatnonzero(np.diff(code, prepend=-1))
        named = pdf[list(self.keys)].iloc[firsts].astype(object)
        names = [tuple(None if pd.isna(v) else v for v in row) for row in named.itertuples(index=False, name=None)]
        states, now = self._current(timerValues)
        after, out = self.fold(names, [states.get(n, (0, None))[1] for n in names], pdf, code)
        states.update({n: (now, state) for n, state in zip(names, after) if state is not None})
        self._write(states)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._current(timerValues)[0])
        return iter([])

    def close(self) -> None:
        pass


def _fresh(rows: pd.DataFrame, code: np.ndarray, order: str, lasts: Sequence[int | None], usable: np.ndarray | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """The first usable row of each place after the last one that the series has seen."""
    at = rows[order].to_numpy()
    known = np.array([last is not None for last in lasts], bool)
    kept = ~known[code] | (at > np.array([last if last is not None else 0 for last in lasts], np.int64)[code])
    if usable is not None:
        kept &= usable
    rows, code, at = rows[kept].reset_index(drop=True), code[kept], at[kept]
    again = np.zeros(len(at), bool)
    again[1:] = (code[1:] == code[:-1]) & (at[1:] == at[:-1])
    return rows[~again].reset_index(drop=True), code[~again]


def _spans(code: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Number, first and end row of each series that has rows."""
    starts = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
    return zip(code[starts].tolist(), starts, [*starts[1:], len(code)])


def _run(
    df: DataFrame, keys: Sequence[str], processor: _Fold, schema: StructType | str, expire_ms: int | None
) -> DataFrame:
    processor.expire_ms, processor.keys = expire_ms, tuple(keys)
    mode = "None" if expire_ms is None else "ProcessingTime"
    # Integers go as text, as pandas has none beside nulls.
    kinds = {k: df.schema[k].dataType for k in keys if isinstance(df.schema[k].dataType, IntegralType)}
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    made = StructType([StructField(f.name, StringType()) if f.name in kinds else f for f in fields])
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).withColumns({k: F.col(k).cast("string") for k in kinds})
    out = rows.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=made, outputMode="Append", timeMode=mode
    )
    return out.withColumns({k: F.col(k).cast(kind) for k, kind in kinds.items()})


# --- T01 ---------------------------------------------------------------------------------------------


class _Before(_Fold):
    """Gives every row the row before it; the state is the last row of an entity."""

    order = ("pos",)
    columns = ("episode", "entity", "kind", "pos", "ts_s", "T")

    def fold(self, names, states, pdf, code):
        rows, code = _fresh(pdf, code, "pos", [None if s is None else s[0] for s in states])
        rows = rows[list(self.columns)]
        states = list(states)
        before = {c: rows[c].astype(object).shift().to_numpy(object) for c in ("pos", "ts_s", "T")}
        for k, start, end in _spans(code):
            for c, value in zip(("pos", "ts_s", "T"), states[k] or (None, None, None)):
                before[c][start] = value
            last = rows.iloc[end - 1]
            states[k] = (int(last["pos"]), float(last["ts_s"]), None if last["T"] is None else list(map(float, last["T"])))
        return states, rows.assign(**{f"_b_{c}": pd.Series(v, dtype=object) for c, v in before.items()})


def entity_motion(stream: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """Steps, speeds and turns as frames arrive (T01): only the row before is state, the rest is shared with the batch form.

    Columns: ``episode, entity, kind, pos, ts_s, T``.
    """
    rows = stream.select("episode", "entity", "kind", "pos", "ts_s", "T")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    before = _run(rows, ["episode", "entity"], _Before(), f"{schema}, _b_pos long, _b_ts_s double, _b_T array<double>", expire_ms)
    last = F.struct(*[F.col(f"_b_{c}").alias(c) for c in ("pos", "ts_s", "T")])
    before = before.select(*rows.columns, F.when(F.col("_b_pos").isNotNull(), last).alias("_b"))
    return audit.motion_columns(before.withColumn("dt", F.col("ts_s") - F.col("_b.ts_s")))


def motion_audit(stream: DataFrame, period: float, cfg: dict | None = None, expire_ms: int | None = None) -> DataFrame:
    """Temporal and motion issues as frames arrive (T01), by the checks of the batch audit.

    The median frame period, which a stream does not know, is declared; the camera's rows are the clock.
    """
    motion = entity_motion(stream, expire_ms).withColumn("episode_median_dt", F.lit(float(period)))
    clock = F.col("kind") == "camera"
    checks = [F.when(clock, c) for c in audit.temporal_checks(cfg)] + audit.motion_checks(cfg)
    return explode_checks(motion, checks, "pos")


# --- T02 ---------------------------------------------------------------------------------------------


class _Grasp(_Fold):
    def __init__(self, machine: Hysteresis):
        self.machine = machine

    def fold(self, names, states, pdf, code):
        rows, code = _fresh(pdf, code, "frame_idx", [None if s is None else s[0] for s in states])
        states, grasp = list(states), np.zeros(len(rows), np.int32)
        ratio, index = rows["ratio"].to_numpy(float), rows["frame_idx"].to_numpy()
        for k, start, end in _spans(code):
            grasp[start:end], exit_ = self.machine.replay(ratio[start:end], 0 if states[k] is None else states[k][1])
            states[k] = (int(index[end - 1]), exit_)
        return states, rows[["episode", "side", "frame_idx"]].assign(grasp_state=grasp)


def grasp_hysteresis(stream: DataFrame, machine: Hysteresis | None = None, expire_ms: int | None = None) -> DataFrame:
    """Grasp state from ``episode, side, frame_idx, ratio``."""
    kind = stream.schema["episode"].dataType.simpleString()
    schema = f"episode {kind}, side string, frame_idx long, grasp_state int"
    return _run(stream, ["episode", "side"], _Grasp(machine or Hysteresis()), schema, expire_ms)


# --- T03 ---------------------------------------------------------------------------------------------


class _Latch(_Fold):
    order = ("frame_idx", "side")

    def __init__(self, policy: str):
        self.policy = policy

    def fold(self, names, states, pdf, code):
        out, after = [], list(states)
        fields = [pdf[c].tolist() for c in ("frame_idx", "side", "grasp", "T", "obj", "is_anchor")]
        for k, start, end in _spans(code):
            poses, anchor, machine, lasts = {}, None, {}, {}
            if states[k] is not None:
                flat, anchor, kept, lasts = states[k]
                poses = {n: np.asarray(p, float).reshape(4, 4) for n, p in flat.items()}
                lasts = dict(lasts)
                machine = {s: {"phase": f, "obj": o, "offset": None if m is None else np.asarray(m, float).reshape(4, 4)} for s, (f, o, m) in kept.items()}
            hands, now = {}, None

            def step(hands=None, now=None):
                moved = reference_step(machine, self.policy, poses, hands, anchor)
                out.extend((names[k][0], now, obj, pose.ravel()) for obj, pose in moved.items())
                lasts.update(dict.fromkeys(hands, now))

            for frame, side, grasp, pose, obj, is_anchor in zip(*(f[start:end] for f in fields)):
                if frame < 0:  # static objects are announced before the first frame
                    poses[obj] = np.asarray(pose, float).reshape(4, 4)
                    anchor = obj if is_anchor else anchor
                    continue
                if hands and frame != now:
                    step(hands, now)
                    hands = {}
                now = int(frame)
                # The guard is per side: the second hand of a frame may come in a later micro-batch.
                if now > lasts.get(side, -1):
                    hands[side] = (bool(grasp), None if pose is None else np.asarray(pose, float).reshape(4, 4))
            if hands:
                step(hands, now)
            flat = lambda p: None if p is None else list(map(float, p.ravel()))
            after[k] = (
                {n: flat(p) for n, p in poses.items()}, anchor,
                {s: (m["phase"], m["obj"], flat(m["offset"])) for s, m in machine.items()}, lasts,
            )
        return after, pd.DataFrame(out, columns=["episode", "frame_idx", "obj", "T"])


def latch(stream: DataFrame, policy: str = "dataset", expire_ms: int | None = None) -> DataFrame:
    """Poses of objects that follow a hand.

    Rows: ``episode, frame_idx, side, grasp, T`` and, with ``frame_idx = -1``, the objects as
    ``obj, T, is_anchor``. A hand of a frame that arrives in a later micro-batch is applied when it comes.
    """
    kind = stream.schema["episode"].dataType.simpleString()
    schema = f"episode {kind}, frame_idx long, obj string, T array<double>"
    return _run(stream, ["episode"], _Latch(policy), schema, expire_ms)


# --- T04 ---------------------------------------------------------------------------------------------


class _Command(_Fold):
    def __init__(self, options: dict):
        self.options = options

    def fold(self, names, states, pdf, code):
        rows, code = _fresh(pdf, code, "frame_idx", [None if s is None else s[0] for s in states], pdf["T"].notna().to_numpy())
        states, spans = list(states), list(_spans(code))
        if not spans:
            return states, pd.DataFrame(columns=["episode", "side", "frame_idx", "command"])
        entry = [states[k] for k, _, _ in spans]
        first = np.array([np.eye(4).ravel() if s is None else s[1] for s in entry], float).reshape(-1, 4, 4)
        held = np.array([s is not None for s in entry], bool)
        poses = np.array(rows["T"].tolist(), float)
        starts = np.array([start for _, start, _ in spans])
        command = command_steps(poses, np.ones(len(rows), bool), starts, first, held, **self.options)
        index = rows["frame_idx"].to_numpy()
        for k, _, end in spans:
            states[k] = (int(index[end - 1]), command[end - 1].tolist())
        return states, rows[["episode", "side", "frame_idx"]].assign(command=list(command))


def command_smoothing(
    stream: DataFrame, alpha_pos: float = 0.5, alpha_rot: float = 0.5, max_pos_step: float = 0.05,
    max_rot_step: float | None = None, expire_ms: int | None = None,
) -> DataFrame:
    """Smoothed and clamped pose commands from ``episode, side, frame_idx, T``."""
    kind = stream.schema["episode"].dataType.simpleString()
    options = dict(alpha_pos=alpha_pos, alpha_rot=alpha_rot, max_pos_step=max_pos_step, max_rot_step=max_rot_step)
    schema = f"episode {kind}, side string, frame_idx long, command array<double>"
    return _run(stream, ["episode", "side"], _Command(options), schema, expire_ms)


# --- T05 ---------------------------------------------------------------------------------------------


class _Nearest(StatefulProcessor):
    """Two buffers per recording: frames that wait, and tracking rows that a frame may still need.

    A frame is decided once the watermark has passed its time plus the tolerance: no tracking row that could be closer
    can still arrive. A timer at the earliest such moment decides frames of a recording that has gone quiet.
    """

    schema = "frames array<long>, times array<long>, tracks array<long>, track_times array<long>"
    columns = ("episode", "frame_idx", "tracking_index", "delta_us", "within_tolerance")

    def __init__(self, tolerance_us: int):
        self.tolerance = tolerance_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("buffers", self.schema)

    def _decide(self, key, timerValues, new: list[np.ndarray]) -> pd.DataFrame:
        kept = self.cell.get() if self.cell.exists() else ((), (), (), ())
        frames, times, tracks, track_times = (np.concatenate([np.asarray(a, np.int64), b]) for a, b in zip(kept, new))
        by_time = np.lexsort((tracks, track_times))
        tracks, track_times = tracks[by_time], track_times[by_time]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due = times + self.tolerance <= mark
        out = self._matches(key[0], frames[due], times[due], tracks, track_times)
        frames, times = frames[~due], times[~due]
        needed = min([mark, *times.tolist()]) - self.tolerance
        tracks, track_times = tracks[track_times >= needed], track_times[track_times >= needed]
        # A timer of an earlier time that still stands finds nothing due and sets the next one.
        if len(frames) or len(tracks):
            self.cell.update(tuple(a.tolist() for a in (frames, times, tracks, track_times)))
            # Without a waiting frame the tracking rows are let go once no frame can need them.
            at = times.min() if len(frames) else track_times.max() + 1
            self.handle.registerTimer(int(-(-(int(at) + self.tolerance) // 1000)))
        else:
            self.cell.clear()
        return out

    def _matches(self, episode, frames, times, tracks, track_times) -> pd.DataFrame:
        right = np.searchsorted(track_times, times, "left")
        padded = np.concatenate([[np.iinfo(np.int64).min // 2], track_times, [np.iinfo(np.int64).max // 2]])
        before, after = times - padded[right], padded[right + 1] - times
        at = np.where(before <= after, right - 1, right)
        near = np.minimum(before, after) <= self.tolerance
        at = np.clip(at, 0, max(len(tracks) - 1, 0))
        index = pd.array(tracks[at] if len(tracks) else np.zeros(len(frames), np.int64), "Int64")
        delta = pd.array((track_times[at] - times) if len(tracks) else np.zeros(len(frames), np.int64), "Int64")
        index[~near], delta[~near] = pd.NA, pd.NA
        return pd.DataFrame({"episode": episode, "frame_idx": frames, "tracking_index": index, "delta_us": delta, "within_tolerance": near})[list(self.columns)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        video, track = pdf[pdf["frame_idx"].notna()], pdf[pdf["tracking_index"].notna()]
        new = [video["frame_idx"], video["at_us"], track["tracking_index"], track["at_us"]]
        yield self._decide(key, timerValues, [c.to_numpy(np.int64) for c in new])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._decide(key, timerValues, [np.zeros(0, np.int64)] * 4)

    def close(self) -> None:
        pass


def synchronise(video: DataFrame, tracking: DataFrame, tolerance_us: int = 50_000, delay: str = "10 seconds") -> DataFrame:
    """The nearest tracking row of each video frame, one row per frame.

    ``video``: ``episode, frame_idx, ts``; ``tracking``: ``episode, tracking_index, tracking_ts``, both timestamps. The
    earlier row wins a tie. A frame without a row in the tolerance comes with nulls. Rows of either stream that are later
    than the watermark are dropped. Frames stay undecided until the watermark passes them: end a bounded stream with
    :func:`closing` rows.
    """
    number = F.lit(None).cast("long")
    v = video.select("episode", F.col("frame_idx").cast("long").alias("frame_idx"), number.alias("tracking_index"), "ts")
    t = tracking.select("episode", number.alias("frame_idx"), F.col("tracking_index").cast("long").alias("tracking_index"), F.col("tracking_ts").alias("ts"))
    both = v.withWatermark("ts", delay).unionByName(t.withWatermark("ts", delay)).withColumn("at_us", F.unix_micros("ts"))
    kind = video.schema["episode"].dataType.simpleString()
    schema = f"episode {kind}, frame_idx long, tracking_index long, delta_us long, within_tolerance boolean"
    return both.groupBy("episode").transformWithStateInPandas(
        statefulProcessor=_Nearest(tolerance_us), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def closing(rows: DataFrame, index: str, ts: str, after: str) -> DataFrame:
    """A row without an index that moves the watermark of a bounded stream ``after`` its last time."""
    last = rows.agg(F.max_by("episode", ts).alias("episode"), (F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    return last.withColumn(index, F.lit(None).cast(rows.schema[index].dataType)).select(*rows.columns)


# --- T06 ---------------------------------------------------------------------------------------------


def distinct_frames(stream: DataFrame, ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """Drop repeated frames that arrive within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["episode", "frame_idx"])
