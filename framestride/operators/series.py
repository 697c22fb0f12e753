"""Ordered-series primitives that never put a whole recording into one task.

A series is identified by ``keys`` (a recording, or a recording and a side) and ordered by an
integer column. One recording may hold a large share of all rows, so a plain
``Window.partitionBy(keys)`` is not used on rows. Every series is cut into chunks:

* rows are windowed inside ``(keys, chunk)``;
* each chunk is reduced to one summary row, the summaries are windowed per series, and the
  resulting *carry* is joined back to the chunk.

With an integer order that is unique per series a chunk holds at most ``chunk_rows`` rows.
When the key column carries a measured bound (see :mod:`framestride.operators.bounds`) that fits one
chunk, the plain window is used: one shuffle, no carry. Fixed-width windows over dense positions use :func:`with_halo`, which copies the few border rows
into the neighbouring chunk and needs no join at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestride.operators.bounds import fits
from framestride.session import chunk_rows, hot_rows, stage

CHUNK = "_chunk"
_LO = Window.unboundedPreceding
_HI = Window.unboundedFollowing


def chunk_by_index(df: DataFrame, order: str, rows: int | None = None) -> DataFrame:
    """Cut a series by its integer index: at most ``rows`` rows per chunk."""
    rows = rows or chunk_rows(df)
    return df.withColumn(CHUNK, F.floor(F.col(order) / F.lit(rows)).cast("long"))


def chunk_hot(df: DataFrame, keys: Sequence[str], order: str, rows: int | None = None) -> DataFrame:
    """Cut only the series with more than ``rows`` rows, evenly over the span of ``order``.

    The lookup of hot series has at most (all rows / ``rows``) entries; Spark broadcasts it while it is small.
    """
    rows = rows or hot_rows(df)
    keys = list(keys)
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        .where(F.col("_n") > rows)
        .select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys],
            "_lo",
            F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / F.lit(rows)))
            .cast("long")
            .alias("_width"),
        )
    )
    on = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    chunk = F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_width")).cast("long"), F.lit(0).cast("long"))
    return (
        df.join(hot, on, "left")
        .withColumn(CHUNK, chunk)
        .drop("_lo", "_width", *[f"_hot_{k}" for k in keys])
    )


# --------------------------------------------------------------------------------------------
# Scans
# --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """One output column: a value inside the chunk, a chunk summary, and the carry over chunks."""

    name: str
    local: Callable  # (window in chunk) -> Column
    summary: Callable  # (order struct) -> aggregate Column
    carry: Callable  # (summary column, window over chunks) -> Column
    merge: Callable  # (local column, carry column) -> Column
    plain: Callable | None = None  # (window over the whole series) -> Column, where `local` is not that


def lag(name: str, value: Column | str) -> Scan:
    """Value of the previous row."""
    plain, value = _c(value), F.struct(_c(value).alias("v"))
    return Scan(
        name,
        lambda w: F.lag(value).over(w),
        lambda o: F.max_by(value, o),
        lambda s, w: F.lag(s).over(w),
        lambda a, b: F.coalesce(a, b)["v"],
        lambda w: F.lag(plain).over(w),
    )


def lead(name: str, value: Column | str) -> Scan:
    """Value of the next row."""
    plain, value = _c(value), F.struct(_c(value).alias("v"))
    return Scan(
        name,
        lambda w: F.lead(value).over(w),
        lambda o: F.min_by(value, o),
        lambda s, w: F.lead(s).over(w),
        lambda a, b: F.coalesce(a, b)["v"],
        lambda w: F.lead(plain).over(w),
    )


def last_valid(name: str, value: Column | str, inclusive: bool = True) -> Scan:
    """Latest non-null value at or before (or strictly before) the row."""
    value = _c(value)
    end = 0 if inclusive else -1
    return Scan(
        name,
        lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(_LO, end)),
        lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(w.rowsBetween(_LO, -1)),
        F.coalesce,
    )


def next_valid(name: str, value: Column | str, inclusive: bool = True) -> Scan:
    """Earliest non-null value at or after (or strictly after) the row."""
    value = _c(value)
    start = 0 if inclusive else 1
    return Scan(
        name,
        lambda w: F.first(value, ignorenulls=True).over(w.rowsBetween(start, _HI)),
        lambda o: F.min_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(w.rowsBetween(1, _HI)),
        F.coalesce,
    )


def running_sum(name: str, value: Column | str) -> Scan:
    """Sum of the value up to and including the row."""
    value = _c(value)
    return Scan(
        name,
        lambda w: F.sum(value).over(w.rowsBetween(_LO, 0)),
        lambda o: F.sum(value),
        lambda s, w: F.sum(s).over(w.rowsBetween(_LO, -1)),
        lambda a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(a + b),
    )


def running_max(name: str, value: Column | str) -> Scan:
    value = _c(value)
    return Scan(
        name,
        lambda w: F.max(value).over(w.rowsBetween(_LO, 0)),
        lambda o: F.max(value),
        lambda s, w: F.max(s).over(w.rowsBetween(_LO, -1)),
        lambda a, b: F.greatest(a, b),
    )


def position(name: str = "pos") -> Scan:
    """Zero-based position of the row in its series."""
    return Scan(
        name,
        lambda w: (F.row_number().over(w) - 1).cast("long"),
        lambda o: F.count(F.lit(1)),
        lambda s, w: F.sum(s).over(w.rowsBetween(_LO, -1)),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )


def of_first(name: str, value: Column | str) -> Scan:
    """Value of the first row of the series, on every row."""
    plain, value = _c(value), F.struct(_c(value).alias("v"))
    return Scan(
        name,
        lambda w: F.lit(None).cast("int"),
        lambda o: F.min_by(value, o),
        lambda s, w: F.first(s).over(w.rowsBetween(_LO, _HI)),
        lambda a, b: b["v"],
        lambda w: F.first(plain).over(w.rowsBetween(_LO, _HI)),
    )


def total(name: str, aggregate: Column, combine: Callable = F.sum) -> Scan:
    """A whole-series aggregate that can be combined from chunk aggregates, on every row."""
    return Scan(
        name,
        lambda w: F.lit(None).cast("int"),
        lambda o: aggregate,
        lambda s, w: combine(s).over(w.rowsBetween(_LO, _HI)),
        lambda a, b: b,
        lambda w: aggregate.over(w.rowsBetween(_LO, _HI)),
    )


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    scans: Sequence[Scan],
    chunked: bool = False,
) -> DataFrame:
    """Add the scan columns. ``chunked`` says that the frame already has a chunk column.

    A split scan reads its input twice (rows and summaries), so the input is staged first unless
    the caller cut the chunks itself.
    """
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    names = {s.name for s in scans}
    if fits(df, keys, chunk_rows(df)):
        w = Window.partitionBy(*keys).orderBy(*order)
        kept = [F.col(c) for c in df.columns if c not in names]
        return df.select(*kept, *[(s.plain or s.local)(w).alias(s.name) for s in scans])
    if not chunked:
        df = chunk_by_index(stage(df), order[0])
    at = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    group = [*keys, CHUNK]
    inner = Window.partitionBy(*group).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(CHUNK)

    summary = df.groupBy(*group).agg(*[s.summary(at).alias(f"_s{i}") for i, s in enumerate(scans)])
    carry = summary.select(
        *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
        *[s.carry(F.col(f"_s{i}"), outer).alias(f"_b{i}") for i, s in enumerate(scans)],
    )
    rows = df.select("*", *[s.local(inner).alias(f"_a{i}") for i, s in enumerate(scans)])
    on = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]
    joined = rows.join(carry, on, "left")
    kept = [c for c in df.columns if c not in names and (chunked or c != CHUNK)]
    return joined.select(
        *[F.col(c) for c in kept],
        *[s.merge(F.col(f"_a{i}"), F.col(f"_b{i}")).alias(s.name) for i, s in enumerate(scans)],
    )


def with_halo(
    df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, rows: int | None = None
) -> tuple[DataFrame, object]:
    """Chunk a densely numbered series and copy border rows into the neighbouring chunks.

    Returns the frame with ``_chunk`` and ``_own`` and the window to use; keep only rows where
    ``_own`` is true after the window columns are computed.
    """
    rows = max(rows or chunk_rows(df), before, after, 1)
    own = F.floor(F.col(pos) / F.lit(rows)).cast("long")
    offset = F.col(pos) - own * rows
    copies = F.array_compact(
        F.array(
            own,
            F.when(offset >= rows - before, own + 1) if before else F.lit(None).cast("long"),
            F.when((offset < after) & (own > 0), own - 1) if after else F.lit(None).cast("long"),
        )
    )
    out = df.withColumn(CHUNK, F.explode(copies)).withColumn("_own", F.col(CHUNK) == own)
    return out, Window.partitionBy(*keys, CHUNK).orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", CHUNK)


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    columns: Callable[[object], dict[str, Column]],
) -> DataFrame:
    """Add fixed-width window columns over dense positions. ``columns`` maps a window to columns."""
    if fits(df, keys, chunk_rows(df)):
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.select("*", *[c.alias(n) for n, c in columns(w).items()])
    halo, w = with_halo(df, keys, pos, before, after)
    # Columns are computed one layer at a time so that no later select sees the copied rows.
    return drop_halo(halo.select("*", *[c.alias(n) for n, c in columns(w).items()]))


def densify(df: DataFrame, keys: Sequence[str], order: str, name: str = "pos") -> DataFrame:
    """Add the zero-based dense position of each row."""
    return scan(df, keys, order, [position(name)])


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
