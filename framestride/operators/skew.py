"""Quantiles whose hot groups are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestride.operators.bounds import fits
from framestride.session import hot_rows, stage


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows and the number of salts they need.

    At most (all rows / ``rows``) keys can be hot.
    """
    rows = rows or hot_rows(df)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("_salts"))
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    names: Sequence[str],
    max_rows: int | None = None,
) -> DataFrame:
    """Exact linear quantiles per key; nulls are skipped.

    Ordinary groups use the ``percentile`` aggregate, whose buffer holds the distinct values of one
    group. Groups with more than ``max_rows`` values are ranked without ever meeting in one task:
    counts per power of two, then per 1/4096 of the wanted power of two, locate the wanted ranks,
    and only the values of that narrow range are sorted.
    """
    max_rows = max_rows or hot_rows(df)
    keys = list(keys)
    valid = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if fits(valid, keys, max_rows):
        return _percentiles(valid, keys, quantiles, names)
    valid = stage(valid)
    hot = hot_keys(valid, keys, max_rows).drop("_salts")
    if not hot.take(1):
        return _percentiles(valid, keys, quantiles, names)
    usual = _percentiles(valid.join(hot, keys, "left_anti"), keys, quantiles, names)
    large = _ranked_quantiles(valid.join(hot, keys, "left_semi"), keys, quantiles, names, max_rows)
    return usual.unionByName(large)


def _percentiles(valid: DataFrame, keys: list[str], quantiles: Sequence[float], names: Sequence[str]) -> DataFrame:
    q = F.percentile("_v", F.array(*[F.lit(float(q)) for q in quantiles])).alias("_q")
    return valid.groupBy(*keys).agg(q).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def _ranked_quantiles(
    df: DataFrame, keys: list[str], quantiles: Sequence[float], names: Sequence[str], max_rows: int
) -> DataFrame:
    steps = 4096
    v = F.col("_v")
    # Infinities and NaN (the largest value) have classes of their own.
    power = (
        F.when(v == 0, F.lit(0))
        .when(F.isnan(v), F.lit(5001))
        .when(F.abs(v) == F.lit(float("inf")), (F.signum(v) * 5000).cast("int"))
        .otherwise((F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100)).cast("int"))
    )
    coarse = (
        df.withColumn("_b", power)
        .groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    by_key = Window.partitionBy(*keys)
    coarse = coarse.withColumn("_n", F.sum("_c").over(by_key)).withColumn(
        "_below", F.sum("_c").over(by_key.orderBy("_b")) - F.col("_c")
    )
    wanted = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("q"),
                    F.lit(upper).alias("upper"),
                    (F.ceil if upper else F.floor)(F.lit(float(q)) * (F.col("_n") - 1)).cast("long").alias("rank"),
                    (F.lit(float(q)) * (F.col("_n") - 1)).alias("at"),
                )
                for i, q in enumerate(quantiles)
                for upper in (False, True)
            ]
        )
    ).alias("_w")

    def pick(counted: DataFrame, rank: Column) -> DataFrame:
        inside = (rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_c"))
        return counted.where(inside)

    first = pick(coarse.select("*", wanted), F.col("_w.rank")).select(
        *keys, "_b", "_lo", "_hi", "_w.q", "_w.upper", "_w.at", (F.col("_w.rank") - F.col("_below")).alias("_rank")
    )
    ranges = first.select(*keys, "_b", "_lo", "_hi").distinct()
    step = F.when(F.col("_hi") > F.col("_lo"), F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps))
    narrowed = df.withColumn("_b", power).join(ranges, [*keys, "_b"]).withColumn(
        "_s", F.coalesce(step.cast("int"), F.lit(0))
    )
    by_range = Window.partitionBy(*keys, "_b")
    fine = narrowed.groupBy(*keys, "_b", "_s").agg(F.count(F.lit(1)).alias("_c"))
    fine = fine.withColumn("_below", F.sum("_c").over(by_range.orderBy("_s")) - F.col("_c"))
    second = pick(
        fine.join(first.drop("_lo", "_hi"), [*keys, "_b"]), F.col("_rank")
    ).select(*keys, "_b", "_s", "q", "upper", "at", (F.col("_rank") - F.col("_below")).alias("_rank"))

    cells = second.select(*keys, "_b", "_s").distinct()
    values = narrowed.join(cells, [*keys, "_b", "_s"]).groupBy(*keys, "_b", "_s", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    by_cell = Window.partitionBy(*keys, "_b", "_s").orderBy("_v")
    values = values.withColumn("_below", F.sum("_c").over(by_cell) - F.col("_c"))
    found = pick(values.join(second, [*keys, "_b", "_s"]), F.col("_rank"))

    def bound(i: int, upper: bool) -> Column:
        return F.max(F.when((F.col("q") == i) & (F.col("upper") == upper), F.col("_v")))

    def result(i: int) -> Column:
        at = F.max(F.when(F.col("q") == i, F.col("at")))
        lo, hi = bound(i, False), bound(i, True)
        part = at - F.floor(at)
        return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)

    return found.groupBy(*keys).agg(*[result(i).alias(n) for i, n in enumerate(names)])
