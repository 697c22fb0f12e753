"""Measured bounds on the number of positions per key, carried as column metadata.

The bound counts positions (frames) of a series. It stays true for rows that are copied per entity, side or method as
long as the group keys tell the copies apart; a group that mixes copies must declare its own bound with
:func:`with_bound`. :func:`measure` counts the rows per key once, at the source, and attaches the maximum to the key
column. Spark keeps column metadata through projections, filters and joins, so later operators can
tell without another job whether every group fits one task. A group of unknown or larger size is
split. The bound only selects the plan: both plans give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY, _ROWS = "framestride.maxRows", "framestride.rows"
#: Rows of a partition of whole groups, and the fewest for which a further core is worth a task.
PART_ROWS, LEAST_ROWS = 65_536, 4096


def with_bound(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """Declare that no value of ``key`` has more than ``rows`` rows, and how many rows there are about in all."""
    known = dict(df.schema[key].metadata) | {_KEY: int(rows)} | ({} if total is None else {_ROWS: int(total)})
    return df.withColumn(key, F.col(key).alias(key, metadata=known))


def measure(df: DataFrame, key: str) -> DataFrame:
    """Attach the largest number of rows per value of ``key`` and their total: one counting job, one row collected."""
    top, total = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return with_bound(df, key, top or 0, total or 0)


def bound(df: DataFrame, keys: Sequence[str]) -> int | None:
    """The smallest known bound among the keys, or None."""
    known = [df.schema[k].metadata.get(_KEY) for k in keys]
    known = [k for k in known if k is not None]
    return min(known) if known else None


def fits(df: DataFrame, keys: Sequence[str], rows: int) -> bool:
    """Whether every group of ``keys`` is known to have at most ``rows`` rows."""
    b = bound(df, keys)
    return b is not None and b <= rows


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole groups dealt to as many partitions as the measured rows need, so that a task's share does not grow with them.

    Windows, groupings and folds by these keys and more take the partitions as they are. A number that is asked for is not
    coalesced by adaptive execution, which goes by bytes and would put many small groups into one task. Without a
    measured number of rows the session's number of partitions is taken.
    """
    rows = [df.schema[k].metadata[_ROWS] for k in keys if _ROWS in df.schema[k].metadata]
    if not rows:
        return df.repartition(*keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(rows[0] / PART_ROWS), min(cores, math.ceil(rows[0] / LEAST_ROWS))), *keys)
