"""Turns of conversations in order, without ever putting a whole conversation into one task.

A turn is identified by ``conv_id``, ``turn``, ``role`` and two 64-bit hashes of its text; the text itself stays out of
what is sorted. Turns are range-partitioned by these, so a conversation of any length is cut where a partition ends, and
positions and running values come from scans over the cuts.

Defined results: a null conv_id is a conversation of its own; turns come in ascending order, nulls first; turns of equal
number are ordered by role and then by the hashes of their texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.operators.series import CHUNK
from framestride.session import stage

#: What tells turns apart, in order.
KEYS = ["conv_id", "turn", "role", "h1", "h2"]


def identified(rows: DataFrame, null: str) -> DataFrame:
    """``KEYS`` and text of all rows; null roles and texts become ``null``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    return rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``KEYS``, written in order, with their cut as the chunk column of the series scans."""
    # The row number parts equal rows, so many copies of one row do not share a partition.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return stage(rows.repartitionByRange(*KEYS, "_row").drop("_row").withColumn(CHUNK, F.spark_partition_id().cast("long")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the keys are those of the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on: list[Column] = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
