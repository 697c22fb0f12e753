"""Pixel statistics on luma tables; decoding images is the caller's job.

An image is a row with ``luma ARRAY<INT>`` (row-major, 0 to 255), ``w`` and ``h``. All figures are
computed inside the row: an image is bounded by its own size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framestride.functions.geometry import let, lit


def _sum(a: Column) -> Column:
    return F.aggregate(a, lit(0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def variance(a: Column) -> Column:
    """Population variance."""
    return let(a, lambda v: let(mean(v), lambda m: F.aggregate(v, lit(0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)))


def laplacian(luma: Column, w: Column, h: Column) -> Column:
    """Four-neighbour Laplacian with the border reflected without repeating the edge."""

    def at(x, y):
        return F.get(luma, (y * w + x).cast("int"))

    def reflect(i, n):
        i = F.when(i < 0, -i).otherwise(i)
        return F.when(i >= n, 2 * n - 2 - i).otherwise(i)

    def pixel(i):
        x, y = i % w, F.floor(i / w)
        return (
            at(reflect(x - 1, w), y) + at(reflect(x + 1, w), y) + at(x, reflect(y - 1, h)) + at(x, reflect(y + 1, h))
            - 4 * F.get(luma, i)
        ).cast("double")

    return F.transform(F.sequence(F.lit(0), (w * h - 1).cast("int")), pixel)


def entropy(luma: Column) -> Column:
    """Entropy in bits of the 256 grey levels."""
    sorted_ = F.array_sort(luma)

    def bits(v):
        n = F.size(v)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, F.greatest(i - 1, F.lit(0))))
        )

        def from_runs(s):
            ends = F.concat(F.slice(s, 2, F.size(s)), F.array(n))
            return -_sum(F.zip_with(s, ends, lambda a, b: (b - a) / n * F.log2((b - a) / n)))

        return let(starts, from_runs)

    return let(sorted_, bits)


def statistics(luma: Column, w: Column, h: Column, under: int = 8, over: int = 247) -> Column:
    """Brightness, contrast, blur, entropy and exposure of a luma image."""
    share = lambda cond: F.size(F.filter(luma, cond)) / F.size(luma)
    return F.struct(
        mean(luma).alias("brightness"),
        F.sqrt(variance(luma)).alias("contrast"),
        variance(laplacian(luma, w, h)).alias("blur_laplacian"),
        entropy(luma).alias("entropy"),
        share(lambda x: x <= under).alias("underexposed_frac"),
        share(lambda x: x >= over).alias("overexposed_frac"),
        w.alias("image_w"),
        h.alias("image_h"),
    )


def resize_area(luma: Column, w: Column, h: Column, tw: int, th: int) -> Column:
    """Area-averaged resize to ``tw`` x ``th``, rounded to whole levels; partial pixels count by their share."""

    def overlap(cell, i, n, t):
        lo, hi = cell * n / lit(t), (cell + 1) * n / lit(t)
        return F.greatest(lit(0), F.least(hi, (i + 1).cast("double")) - F.greatest(lo, i.cast("double")))

    def span(cell, n, t):
        first = F.floor(cell * n / lit(t)).cast("int")
        last = F.least(F.ceil((cell + 1) * n / lit(t)), n).cast("int") - 1
        return F.sequence(first, F.greatest(first, last))

    def cell(c):
        cx, cy = c % tw, F.floor(c / tw).cast("int")
        rows = F.transform(
            span(cy, h, th),
            lambda y: _sum(
                F.transform(
                    span(cx, w, tw),
                    lambda x: F.get(luma, (y * w + x).cast("int")) * overlap(cx, x, w, tw) * overlap(cy, y, h, th),
                )
            ),
        )
        return F.rint(_sum(rows) / (w * h / lit(tw * th)))

    return F.transform(F.sequence(F.lit(0), F.lit(tw * th - 1)), cell)


def difference_hash(small: Column) -> Column:
    """16 hex digits of a 9x8 image: each bit says whether a pixel is brighter than its left one."""
    bits = [
        F.when(F.get(small, F.lit(9 * y + x + 1)) > F.get(small, F.lit(9 * y + x)), "1").otherwise("0")
        for y in range(8)
        for x in range(8)
    ]
    return F.lower(F.lpad(F.conv(F.concat(*bits), 2, 16), 16, "0"))


def hsv_histogram(values: Column, top: float, bins: int = 12) -> Column:
    """Normalised histogram of one channel."""
    count = lambda b: F.size(
        F.filter(values, lambda v: F.least(F.floor(v / lit(top) * bins), F.lit(bins - 1)) == b)
    ) / F.size(values)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), count)


def appearance(small8: Column, hue: Column, saturation: Column, value: Column) -> Column:
    """100 numbers: an 8x8 luma image over 255 and three 12-bin histograms."""
    return F.concat(
        F.transform(small8, lambda x: x / lit(255)),
        hsv_histogram(hue, 180.0),
        hsv_histogram(saturation, 256.0),
        hsv_histogram(value, 256.0),
    )


def coverage(mask: Column) -> Column:
    """Share of mask pixels above 127."""
    return F.size(F.filter(mask, lambda x: x > 127)) / F.size(mask)


def object_coverage(coverages: Column) -> Column:
    """Mean and minimum over the object masks of a frame."""
    ok = F.array_compact(coverages)
    some = F.size(ok) > 0
    return F.struct(F.when(some, mean(ok)).alias("mean_coverage"), F.when(some, F.array_min(ok)).alias("min_coverage"))
