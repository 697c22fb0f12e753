"""Issue rows: one pass over the data, an array of checks per row, exploded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_SCHEMA = (
    "severity string, category string, episode string, frame string, metric string, "
    "value string, value_num double, threshold string, message string"
)


def check(
    condition: Column,
    severity: str | Column,
    category: str,
    metric: str | Column,
    value: Column,
    threshold: str | Column,
    message: str | Column,
) -> Column:
    """A struct when the condition holds, otherwise null."""

    def s(x):
        return F.lit(x) if isinstance(x, str) else x

    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(
            s(severity).alias("severity"),
            F.lit(category).alias("category"),
            s(metric).alias("metric"),
            value.cast("string").alias("value"),
            value.cast("string").try_cast("double").alias("value_num"),
            s(threshold).alias("threshold"),
            s(message).alias("message"),
        ),
    )


def explode_checks(df: DataFrame, checks: Sequence[Column], frame: str | Column = "frame_idx") -> DataFrame:
    """Issue rows of all checks that fired (bag semantics)."""
    frame = F.col(frame) if isinstance(frame, str) else frame
    fired = df.select(
        F.col("episode").cast("string").alias("episode"),
        frame.cast("string").alias("frame"),
        F.explode(F.array_compact(F.array(*checks))).alias("i"),
    )
    return fired.select(
        "i.severity", "i.category", "episode", "frame", "i.metric", "i.value", "i.value_num", "i.threshold", "i.message"
    )


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of the issues of all checks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
