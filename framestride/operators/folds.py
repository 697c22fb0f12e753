"""Sequential recursions over a series.

Series that fit a task are worked on many at a time (:func:`bundled`), since a call per series costs more than its rows.
Longer ones go four ways, from most to least parallel:

* hysteresis (:func:`hysteresis`): the state is the last event, and events follow from counts in runs, so
  scans give it. A series of any length runs in parallel.
* exponential averages (:func:`symmetric_ema`): each chunk is reduced to the affine map of its entry
  value, composed in the same way.
* recursions that forget their start (:func:`speculative_fold`): each chunk starts from a warm-up over the end of the
  chunk before it; the chunks' exits show which starts were wrong, and only those chunks run again.
* other recursions (:func:`stream_fold`): one pass over the sorted rows of a series, batch by batch,
  with a state of fixed size. A series is never held in memory, but one task works through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestride.operators import series as S
from framestride.operators.bounds import dealt, fits
from framestride.session import chunk_rows, stage

KEYS = ("episode", "side")


def _with_columns(df: DataFrame, added: str) -> T.StructType:
    names = {f.name for f in T.StructType.fromDDL(added).fields}
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in names]
    return T.StructType(fields + T.StructType.fromDDL(added).fields)


def stream_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``fold`` over the ordered batches of each series."""
    keys, order = list(keys), list(order)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold(batches)

    return ordered.groupBy(*keys).applyInPandas(run, schema)


#: Rows of whole series that one call works on; a series with more rows is one call.
BUNDLE = 16_384


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a series begins, in a table in order of its keys."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        one, two = column[1:], column[:-1]
        fresh[1:] |= pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False)
        fresh[1:] |= one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(fresh)


def bundled(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str
) -> DataFrame:
    """Run ``work(rows, starts)`` over bundles of whole series in order, ``starts`` being the first row of each."""
    keys, size = list(keys), BUNDLE
    rows = dealt(df, keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        count, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            cuts = _starts(part, keys)
            if count >= size:
                # The bundle ends with the series that its last row belongs to.
                border = pa.concat_tables([last, part.slice(0, 1)])
                end = 0 if len(_starts(border, keys)) > 1 else int(cuts[1]) if len(cuts) > 1 else None
                if end is not None:
                    table = pa.concat_tables([*kept, part.slice(0, end)]).combine_chunks()
                    yield from work(table, _starts(table, keys)).to_batches()
                    kept, count, part = [], 0, part.slice(end)
            kept.append(part)
            count += part.num_rows
            last = part.slice(part.num_rows - 1) if part.num_rows else last
        table = pa.concat_tables(kept).combine_chunks() if kept else None
        if table is not None and table.num_rows:
            yield from work(table, _starts(table, keys)).to_batches()

    return rows.mapInArrow(run, schema)


def _with(table: pa.Table, new: dict[str, pa.Array], names: Sequence[str]) -> pa.Table:
    """The table with columns set, in the order of ``names``."""
    return pa.table([new[n] if n in new else table.column(n) for n in names], names=list(names))


def _matrices(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ``size`` numbers as rows, and which rows there are."""
    known = column.is_valid().to_numpy()
    lists = column.drop_null().combine_chunks()
    if len(lists) and not pc.all(pc.equal(pc.list_value_length(lists), size)).as_py():
        raise ValueError(f"expected lists of {size} numbers")
    out = np.zeros((len(known), size))
    if len(lists):
        out[known] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    return out, known


def _lists(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of numbers as lists, null where there is none."""
    ends = np.concatenate([[0], np.cumsum(known)]) * values.shape[1]
    offsets = pa.array(ends.astype(np.int32), mask=np.concatenate([~known, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values[known]).ravel()))


def _in_step(starts: np.ndarray, count: int):
    """For each place in a series, the series that reach it and the rows there; longest series first."""
    lengths = np.diff(np.concatenate([starts, [count]]))
    order = np.argsort(-lengths, kind="stable")
    ascending = lengths[order][::-1]
    for at in range(int(lengths.max(initial=0))):
        live = order[: len(order) - int(np.searchsorted(ascending, at, "right"))]
        yield live, starts[live] + at


#: Rounds of repair before the series that still have a wrong start go through one task each.
_ROUNDS = 4
#: Largest difference of two states that count as one.
_SAME = 1e-11


def _matching(df: DataFrame, other: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which null keys are equal."""
    right = other.select(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(names)])
    return df.join(right, [F.col(n).eqNullSafe(F.col(f"_o{i}")) for i, n in enumerate(names)], how)


def speculative_fold(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    column: str,
    name: str,
    run: Callable[[Sequence, np.ndarray | None], tuple[list, np.ndarray | None, bool]],
    match: Callable[[np.ndarray, np.ndarray], np.ndarray | None],
    warm: int,
    schema: T.StructType,
) -> DataFrame:
    """A recursion over ``column`` that forgets its start, chunk by chunk in parallel.

    ``run(values, state)`` returns the outputs, the state after them and whether the recursion restarted on the way, so
    that its exit does not depend on its entry. ``match(state, guess)`` gives the factors that turn the guess into the
    state, or None where they differ; the exit of a chunk that did not restart takes the same factors.

    The guess for a chunk is the state after the last ``warm`` rows of the chunk before it. One walk over one row per chunk
    then compares each guess with the exit before it. Chunks with a wrong guess run again from that exit, for at most
    ``_ROUNDS`` rounds; series that have not settled by then are folded in order, so the result never depends on the guess.
    """
    keys = list(keys)
    group = [*keys, S.CHUNK]
    rows = chunk_rows(df)
    chunked = S.chunk_by_index(stage(df), pos, rows)
    slim = chunked.select(*group, pos, column)
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    head = ", ".join(f"{g} {types[g]}" for g in group)
    state = "guess array<double>, exit array<double>, restarted boolean"

    def array(value):
        return None if value is None else np.asarray(value, float)

    def plain(value):
        return None if value is None else value.ravel().tolist()

    near_end = F.pmod(F.col(pos), F.lit(rows)) >= rows - warm
    ends = slim.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.when(near_end, F.struct(F.col(pos).alias("at"), F.col(column).alias("value"))))).alias("end")
    )
    before = F.lag(F.transform("end", lambda r: r["value"])).over(Window.partitionBy(*keys).orderBy(S.CHUNK))
    starts = ends.select(*group, before.alias("end"))

    def exits(key: tuple, pdf: pd.DataFrame, guess: np.ndarray | None) -> pd.DataFrame:
        _, last, restarted = run(pdf.sort_values(pos)[column].tolist(), guess)
        return pd.DataFrame([[*key, plain(guess), plain(last), restarted]], columns=[*group, "guess", "exit", "restarted"])

    def first(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        end = start["end"].iloc[0]
        return exits(key, pdf, None if end is None else run(list(end), None)[1])

    def again(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        return exits(key, pdf, array(start["entry"].iloc[0]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            entries, wrong = [], []
            for guess, last, restarted in zip(pdf["guess"], pdf["exit"], pdf["restarted"]):
                guess, last = array(guess), array(last)
                entries.append(plain(now))
                if now is None or guess is None:
                    factors = 1.0 if now is guess else None
                else:
                    factors = match(now, guess)
                wrong.append(factors is None)
                now = last if last is None or restarted or factors is None else factors * last
            yield pdf.assign(entry=entries, wrong=wrong)

    def walked(summary: DataFrame) -> DataFrame:
        return stage(stream_fold(summary, keys, [S.CHUNK], walk, f"{head}, {state}, entry array<double>, wrong boolean"))

    table = walked(slim.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(first, f"{head}, {state}"))
    for _ in range(_ROUNDS):
        wrong = table.where("wrong")
        if wrong.isEmpty():
            break
        part = _matching(slim, wrong, group, "left_semi")
        repaired = part.groupBy(*group).cogroup(wrong.select(*group, "entry").groupBy(*group)).applyInPandas(again, f"{head}, {state}")
        right = table.where(~F.col("wrong")).select(*group, "guess", "exit", "restarted")
        table = walked(right.unionByName(repaired))

    def finish(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        return pdf.assign(**{name: run(pdf[column].tolist(), array(start["entry"].iloc[0]))[0]})[schema.names]

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            out, now, _ = run(pdf[column].tolist(), now)
            yield pdf.assign(**{name: out})[schema.names]

    entries = table.select(*group, "entry")
    late = table.where("wrong").select(*keys).distinct()
    if late.isEmpty():
        return chunked.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(finish, schema)
    settled = _matching(chunked, late, keys, "left_anti").groupBy(*group)
    done = settled.cogroup(_matching(entries, late, keys, "left_anti").groupBy(*group)).applyInPandas(finish, schema)
    return done.unionByName(stream_fold(_matching(chunked, late, keys, "left_semi"), keys, [pos], in_order, schema))


def _fold(df, keys, pos, column, name, size, run, match, warm, whole, schema) -> DataFrame:
    """Many series at a time where they fit a chunk, else chunks in parallel.

    ``whole(values, known, starts)`` gives the outputs of all rows of a bundle of series.
    """
    if not fits(df, keys, chunk_rows(df)):
        return speculative_fold(df, keys, pos, column, name, run, match, warm, schema)

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        values, known = _matrices(table.column(column), size)
        return _with(table, {name: _lists(whole(values, known, starts), known)}, schema.names)

    return bundled(df, keys, [pos], work, schema)


def _forgets(share: float) -> int:
    """Steps after which a state that keeps ``share`` of the one before has forgotten its start."""
    return 1 if share <= 0 else 1 << 20 if share >= 1 else int(np.ceil(np.log(_SAME / 100) / np.log(share)))


# --- grasp hysteresis ------------------------------------------------------------------------------


class Hysteresis:
    """Grasp state with hold times; the whole state is (closed, count, missing)."""

    def __init__(self, close=0.90, open_=1.10, close_hold=3, open_hold=3, missing_hold=5):
        if close >= open_:
            raise ValueError("the close ratio must be below the open ratio")
        self.close, self.open = close, open_
        self.holds = (close_hold, open_hold)
        self.missing_hold = missing_hold
        self.states = [
            (closed, count, missing)
            for closed in (0, 1)
            for count in range(self.holds[closed])
            for missing in range(missing_hold + 2)
        ]
        self.index = {s: i for i, s in enumerate(self.states)}
        kinds = ("missing", "close", "open", "between")
        self.table = np.array([[self.index[self.step(s, k)] for s in self.states] for k in kinds])
        self.closed = np.array([s[0] for s in self.states], dtype=np.int32)

    def step(self, state, kind):
        closed, count, missing = state
        if kind == "missing":
            missing = min(missing + 1, self.missing_hold + 1)
            return (closed, 0 if missing > self.missing_hold else count, missing)
        toward = kind == ("open" if closed else "close")
        count = count + 1 if toward else 0
        if count >= self.holds[closed]:
            return (1 - closed, 0, 0)
        return (closed, count, 0)

    def kinds(self, ratio: np.ndarray) -> np.ndarray:
        return np.where(~np.isfinite(ratio), 0, np.where(ratio <= self.close, 1, np.where(ratio >= self.open, 2, 3)))

    def replay(self, ratio: np.ndarray, entry: int = 0) -> tuple[np.ndarray, int]:
        out = np.empty(len(ratio), dtype=np.int32)
        state = entry
        for i, k in enumerate(self.kinds(ratio)):
            state = self.table[k, state]
            out[i] = self.closed[state]
        return out, int(state)


def hysteresis(
    df: DataFrame, ratio: str, machine: Hysteresis | None = None, keys: Sequence[str] = KEYS, pos: str = "pos",
    name: str = "grasp_state",
) -> DataFrame:
    """Grasp state from the opening ratio; the state is carried through missing rows.

    ``pos`` is dense. A run is a series of close rows, or of open rows, that neither another kind of row nor more than
    ``missing_hold`` missing rows interrupt. Its row number ``close_hold`` (``open_hold``) is an event; the state of a row is
    the last event, so three scans replace the recursion.
    """
    machine = machine or Hysteresis()
    keys = list(keys)
    r = F.col(ratio).cast("double")
    known = F.coalesce(~F.isnan(r) & (F.abs(r) < F.lit(float("inf"))), F.lit(False))
    kind = F.when(known, F.when(r <= machine.close, 1).when(r >= machine.open, 2).otherwise(3))
    rows = df.withColumn("_kind", kind)
    seen = F.col("_kind").isNotNull()
    before = S.last_valid("_before", F.when(seen, F.struct(F.col(pos).alias("at"), F.col("_kind").alias("kind"))), inclusive=False)
    rows = S.scan(rows, keys, pos, [before, S.running_sum("_seen", seen.cast("int"))])
    goes_on = (F.col("_before.kind") == F.col("_kind")) & (F.col(pos) - F.col("_before.at") - 1 <= machine.missing_hold)
    first = F.when(seen & ~F.coalesce(goes_on, F.lit(False)), F.col("_seen"))
    rows = S.scan(rows.withColumn("_f", first), keys, pos, [S.last_valid("_first", "_f")])
    number = F.col("_seen") - F.col("_first") + 1
    closes, opens = machine.holds
    event = F.when((F.col("_kind") == 1) & (number == closes), 1).when((F.col("_kind") == 2) & (number == opens), 0)
    rows = S.scan(rows.withColumn("_e", event), keys, pos, [S.last_valid(name, "_e")])
    return rows.withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("int")).drop("_kind", "_before", "_seen", "_f", "_first", "_e")


# --- exponential averages ---------------------------------------------------------------------------


#: Rows of an average that one matrix product covers.
_BLOCK = 64


def _ema(values: np.ndarray, valid: np.ndarray, alpha: float, entry: np.ndarray | None) -> np.ndarray:
    """Average inside valid runs; ``entry`` is the value before the first row of the chunk, if valid.

    A block of n rows is a triangular matrix of weights times its values, plus the decayed value before it.
    """
    out = np.full_like(values, np.nan)
    age = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)
    weights = np.where(age >= 0, alpha * (1 - alpha) ** np.maximum(age, 0), 0.0)
    decay = (1 - alpha) ** np.arange(1, _BLOCK + 1)[:, None]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], valid, [False]]).astype(np.int8)))
    for first, last in edges.reshape(-1, 2):
        state = values[first] if first or entry is None else entry
        for at in range(first, last, _BLOCK):
            n = min(_BLOCK, last - at)
            out[at : at + n] = weights[:n, :n] @ values[at : at + n] + decay[:n] * state
            state = out[at + n - 1]
    return out


def _emas(x: np.ndarray, valid: np.ndarray, starts: np.ndarray, alpha: float) -> np.ndarray:
    """The averages of many whole series at once: all runs advance by a block together."""
    n = len(x)
    out = np.full_like(x, np.nan)
    fresh = np.zeros(n + 1, bool)
    fresh[starts], fresh[n] = True, True
    first = np.flatnonzero(valid & (fresh[:-1] | ~np.concatenate([[False], valid[:-1]])))
    length = np.flatnonzero(valid & (fresh[1:] | ~np.concatenate([valid[1:], [False]]))) + 1 - first
    size = min(_BLOCK, int(length.max(initial=1)))
    age = np.arange(size)[:, None] - np.arange(size)
    weights = np.where(age >= 0, alpha * (1 - alpha) ** np.maximum(age, 0), 0.0)
    decay = (1 - alpha) ** np.arange(1, size + 1)[:, None]
    state = x[first]
    for at in range(0, int(length.max(initial=0)), size):
        live = np.flatnonzero(length > at)
        rows = first[live, None] + at + np.arange(size)
        inside = at + np.arange(size) < length[live, None]
        block = np.where(inside[..., None], x[np.minimum(rows, n - 1)], 0.0)
        block = np.matmul(weights, block) + decay * state[live][:, None]
        out[rows[inside]] = block[inside]
        state[live] = block[:, -1]
    return out


def _whole_ema(df: DataFrame, columns: list[str], alpha: float, keys: Sequence[str], pos: str) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema.fields])

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns], 1)
        ok = np.isfinite(x).all(axis=1)
        ends = len(x) - np.concatenate([starts[1:], [len(x)]])[::-1]
        mean = (_emas(x, ok, starts, alpha) + _emas(x[::-1], ok[::-1], ends, alpha)[::-1]) / 2
        return _with(table, {c: pa.array(mean[:, i], mask=~ok) for i, c in enumerate(columns)}, schema.names)

    return bundled(df, keys, [pos], work, schema)


def _directed_ema(df, columns, alpha, keys, pos, backward, prefix):
    """One direction of the average. The chunk summary is (exit at zero entry, entry factor, fresh)."""
    columns, keys = list(columns), list(keys)
    names = [f"{prefix}{c}" for c in columns]
    schema = _with_columns(df, ", ".join(f"{n} double" for n in names))

    def ordered(pdf):
        pdf = pdf.sort_values(pos, ascending=not backward)
        x = pdf[columns].to_numpy(float)
        return pdf, x, np.isfinite(x).all(axis=1)

    def emit(pdf, out):
        pdf[names] = out
        return pdf[schema.names]

    chunked = S.chunk_by_index(stage(df), pos)
    group = [*keys, S.CHUNK]
    types = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    head = ", ".join(f"{g} {types[g]}" for g in group)

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, ok = ordered(pdf)
        passes = bool(ok.all())  # otherwise the exit does not depend on the entry
        factor = (1 - alpha) ** len(x) if passes else 0.0
        last = bool(ok[-1])
        fresh = _ema(x, ok, alpha, None)[-1]
        zero = _ema(x, ok, alpha, np.zeros(x.shape[1]))[-1]
        return pd.DataFrame([[*key, fresh, zero, factor, last]], columns=[*group, "fresh", "zero", "factor", "last"])

    summary = chunked.select(*group, pos, *columns).groupBy(*group).applyInPandas(
        reduce, head + ", fresh array<double>, zero array<double>, factor double, last boolean"
    )
    ranked = summary.withColumn("_rank", -F.col(S.CHUNK) if backward else F.col(S.CHUNK))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            entry = []
            for fresh, zero, factor, last in zip(pdf["fresh"], pdf["zero"], pdf["factor"], pdf["last"]):
                entry.append(None if state is None else list(state))
                if not last:
                    state = None
                elif state is None or factor == 0.0:
                    state = np.asarray(fresh, float)
                else:
                    state = np.asarray(zero, float) + factor * state
            yield pdf[group].assign(_entry=entry)

    carry = stream_fold(ranked, keys, ["_rank"], entries, head + ", _entry array<double>")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, ok = ordered(pdf)
        entry = pdf["_entry"].iloc[0]
        return emit(pdf, _ema(x, ok, alpha, None if entry is None else np.asarray(entry, float)))

    return chunked.join(carry, group).groupBy(*group).applyInPandas(finish, schema)


def symmetric_ema(
    df: DataFrame, columns: Sequence[str], alpha: float, keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """Mean of a forward and a backward average inside runs of valid rows."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if fits(df, keys, chunk_rows(df)):
        return _whole_ema(df, list(columns), alpha, keys, pos)
    out = _directed_ema(df, columns, alpha, keys, pos, False, "_f_")
    out = _directed_ema(out, columns, alpha, keys, pos, True, "_b_")
    valid = lambda c: ~F.isnan(c) & F.col(c).isNotNull()
    return out.withColumns(
        {c: F.when(valid(f"_f_{c}"), (F.col(f"_f_{c}") + F.col(f"_b_{c}")) / 2) for c in columns}
    ).drop(*[f"_f_{c}" for c in columns], *[f"_b_{c}" for c in columns])


def _nearest_rotations(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    r = u @ vt
    flip = np.linalg.det(r) < 0
    u[flip, :, -1] *= -1
    return u @ vt


def nearest_rotation(matrix):
    """Closest proper rotation to a 3x3 matrix column; null stays null."""
    return F.pandas_udf(_nearest_rotation_series, T.ArrayType(T.DoubleType()))(matrix)


def _nearest_rotation_series(matrix: pd.Series) -> pd.Series:
    known = [v is not None for v in matrix]
    out: list = [None] * len(matrix)
    if any(known):
        m = np.stack([np.asarray(v, float) for v, k in zip(matrix, known) if k]).reshape(-1, 3, 3)
        found = iter(_nearest_rotations(m).reshape(-1, 9))
        out = [next(found) if k else None for k in known]
    return pd.Series(out, index=matrix.index, dtype=object)


def smooth_rotations(
    df: DataFrame, rotation: str, alpha: float, keys: Sequence[str] = KEYS, pos: str = "pos"
) -> DataFrame:
    """Symmetric average of rotation matrices, projected back to rotations."""
    names = [f"_m{i}" for i in range(9)]
    out = df.withColumns({n: F.get(F.col(rotation), F.lit(i)) for i, n in enumerate(names)})
    out = symmetric_ema(out, names, alpha, keys, pos)
    packed = F.when(F.col(names[0]).isNotNull(), F.array(*names))
    return out.withColumn(rotation, nearest_rotation(packed)).drop(*names)


# --- unit-vector averages and command smoothing -----------------------------------------------------


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-6)


def _blend(axes: np.ndarray, state: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Move unit vectors (rows) towards new ones, each taken with the sign that agrees with its state."""
    signs = np.where((axes * state).sum(-1, keepdims=True) < 0, -1.0, 1.0)
    moved = state + weights * (signs * axes - state)
    return moved / (np.linalg.norm(moved, axis=-1, keepdims=True) + 1e-6)


def smooth_axes(
    df: DataFrame, rotation: str, alpha_x: float = 0.15, alpha_y: float = 0.15, keys: Sequence[str] = KEYS,
    pos: str = "pos",
) -> DataFrame:
    """Average the x and y axes with consistent signs, then rebuild the frame; gaps reset."""
    schema = _with_columns(df, f"{rotation} array<double>")
    weights = np.array([[alpha_x], [alpha_y]])

    def run(values, state):
        out, restarted = [], False
        state = None if state is None else state.reshape(2, 3)
        for m in values:
            if m is None:
                state, restarted = None, True
                out.append(None)
                continue
            axes = np.asarray(m, float).reshape(3, 3)[:, :2].T
            axes = axes / (np.linalg.norm(axes, axis=1, keepdims=True) + 1e-6)
            state = axes if state is None else _blend(axes, state, weights)
            z = _unit(np.cross(*state))
            out.append(np.column_stack([state[0], np.cross(z, state[0]), z]).ravel())
        return out, None if state is None else state.ravel(), restarted

    def match(state, guess):
        """The recursion of an axis that starts with the opposite sign is the same with the opposite sign."""
        state, guess = state.reshape(2, 3), guess.reshape(2, 3)
        signs = np.where((state * guess).sum(1, keepdims=True) < 0, -1.0, 1.0)
        return np.repeat(signs, 3) if np.abs(state - signs * guess).max() <= _SAME else None

    def whole(values, known, starts):
        axes = values.reshape(-1, 3, 3)[:, :, :2].swapaxes(1, 2)
        axes = axes / (np.linalg.norm(axes, axis=-1, keepdims=True) + 1e-6)
        now, held = np.zeros((len(starts), 2, 3)), np.zeros(len(starts), bool)
        states = np.zeros_like(axes)
        for live, rows in _in_step(starts, len(axes)):
            now[live] = np.where(held[live, None, None], _blend(axes[rows], now[live], weights), axes[rows])
            held[live] = known[rows]
            states[rows] = now[live]
        z = np.cross(states[:, 0], states[:, 1])
        z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-6)
        return np.stack([states[:, 0], np.cross(z, states[:, 0]), z], -1).reshape(-1, 9)

    return _fold(df, keys, pos, rotation, rotation, 9, run, match, _forgets(1 - min(alpha_x, alpha_y)), whole, schema)


def _rotation_vector(r: np.ndarray) -> np.ndarray:
    axis = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    sine, cosine = np.linalg.norm(axis), np.clip((np.trace(r) - 1) / 2, -1, 1)
    angle = np.arctan2(sine, cosine)
    if sine > 1e-7:
        return axis / sine * angle
    if cosine > 0:
        return axis
    w, v = np.linalg.eigh((r + r.T) / 2)
    return v[:, np.argmax(w)] * angle


def _rotation(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    k = k / angle
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def _limited(change: np.ndarray, share: float, most: float | None) -> np.ndarray:
    """A share of a change, no longer than ``most``."""
    size = float(np.linalg.norm(change))
    return change * (share if most is None or size * share <= most else most / size)


def smooth_command(
    previous: np.ndarray | None, target: np.ndarray, alpha_pos: float, alpha_rot: float, max_pos_step: float,
    max_rot_step: float | None,
) -> np.ndarray:
    """One step of pose command smoothing with clamps (W48): limited translation, limited turn along the geodesic."""
    if previous is None:
        return target.copy()
    start = previous[:3, :3]
    out = previous.copy()
    out[:3, 3] += _limited(target[:3, 3] - previous[:3, 3], 1 - alpha_pos, max_pos_step)
    out[:3, :3] = start @ _rotation(_limited(_rotation_vector(start.T @ target[:3, :3]), 1 - alpha_rot, max_rot_step))
    return out


def _rotation_vectors(r: np.ndarray) -> np.ndarray:
    """:func:`_rotation_vector` of many rotations."""
    axis = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1) / 2
    sine, cosine = np.linalg.norm(axis, axis=1), np.clip((np.trace(r, axis1=1, axis2=2) - 1) / 2, -1, 1)
    turned = sine > 1e-7
    out = np.where(turned[:, None], axis / np.where(turned, sine, 1.0)[:, None] * np.arctan2(sine, cosine)[:, None], axis)
    for k in np.flatnonzero(~turned & ~(cosine > 0)):
        out[k] = _rotation_vector(r[k])
    return out


def _rotations(v: np.ndarray) -> np.ndarray:
    """:func:`_rotation` of many vectors."""
    angle = np.linalg.norm(v, axis=1)
    zero = np.zeros(len(v))
    k = np.stack([zero, -v[:, 2], v[:, 1], v[:, 2], zero, -v[:, 0], -v[:, 1], v[:, 0], zero], 1).reshape(-1, 3, 3)
    small = angle < 1e-12
    unit = k / np.where(small, 1.0, angle)[:, None, None]
    full = np.sin(angle)[:, None, None] * unit + (1 - np.cos(angle))[:, None, None] * (unit @ unit)
    return np.eye(3) + np.where(small[:, None, None], k, full)


def _all_limited(change: np.ndarray, share: float, most: float | None) -> np.ndarray:
    """:func:`_limited` of many changes."""
    if most is None:
        return change * share
    size = np.linalg.norm(change, axis=1, keepdims=True)
    inside = size * share <= most
    return change * np.where(inside, share, most / np.where(inside, 1.0, size))


def command_steps(
    values: np.ndarray, known: np.ndarray, starts: np.ndarray, first: np.ndarray, held: np.ndarray, alpha_pos: float,
    alpha_rot: float, max_pos_step: float, max_rot_step: float | None,
) -> np.ndarray:
    """:func:`smooth_command` over many series in step: the pose of each row, 16 numbers; ``first`` and ``held`` are the
    poses before the series and whether there is one, and afterwards those at their ends."""
    target, out = values.reshape(-1, 4, 4), np.zeros((len(values), 4, 4))
    for live, rows in _in_step(starts, len(values)):
        live, rows = live[known[rows]], rows[known[rows]]
        old, new = first[live], target[rows].copy()
        moved, start = old.copy(), old[:, :3, :3]
        moved[:, :3, 3] += _all_limited(new[:, :3, 3] - old[:, :3, 3], 1 - alpha_pos, max_pos_step)
        turn = _all_limited(_rotation_vectors(start.swapaxes(1, 2) @ new[:, :3, :3]), 1 - alpha_rot, max_rot_step)
        moved[:, :3, :3] = start @ _rotations(turn)
        out[rows] = first[live] = np.where(held[live, None, None], moved, new)
        held[live] = True
    return out.reshape(-1, 16)


def smooth_commands(
    df: DataFrame, pose: str, alpha_pos: float = 0.5, alpha_rot: float = 0.5, max_pos_step: float = 0.05,
    max_rot_step: float | None = None, keys: Sequence[str] = KEYS, pos: str = "pos", name: str = "command",
) -> DataFrame:
    """Smoothed pose commands of each series."""
    schema = _with_columns(df, f"{name} array<double>")

    def run(values, state):
        out = []
        last = None if state is None else state.reshape(4, 4)
        for m in values:
            if m is None:
                out.append(None)
                continue
            target = np.asarray(m, float).reshape(4, 4)
            last = smooth_command(last, target, alpha_pos, alpha_rot, max_pos_step, max_rot_step)
            out.append(last.ravel())
        return out, None if last is None else last.ravel(), False

    def match(state, guess):
        return np.ones(16) if np.abs(state - guess).max() <= _SAME else None

    def whole(values, known, starts):
        first, held = np.tile(np.eye(4), (len(starts), 1, 1)), np.zeros(len(starts), bool)
        return command_steps(values, known, starts, first, held, alpha_pos, alpha_rot, max_pos_step, max_rot_step)

    # Clamped steps come nearer by a fixed length, so the warm-up is a multiple of what the shares alone need.
    return _fold(df, keys, pos, pose, name, 16, run, match, 4 * _forgets(max(alpha_pos, alpha_rot)), whole, schema)
