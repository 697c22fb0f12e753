"""The split into documents that models learn from and held-out ones, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is a multiple of 5; a null doc_id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def sampled(rows: DataFrame, label: str, ident: str, most: int) -> DataFrame:
    """About ``most`` rows of each label (all where there are fewer), picked by a hash of ``ident``."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    scale = 1 << 30
    for value, n in counts.items():
        share = min(scale, most * scale // n)
        keep = keep | ((F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(ident, F.lit(7)), F.lit(scale)) < share))
    return rows.where(keep)
