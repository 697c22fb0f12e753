"""Near-duplicate embeddings by sorted projection passes.

A pass gives each vector a key, the sides of random hyperplanes one after another, and orders the vectors of a label
lexicographically by it. Each vector is compared with the next ``WINDOW`` ones in that order. A pass finds a pair that
shares more leading sides than a vector shares with the end of its window. How many those are depends on how the other
vectors lie, and how likely a partner at the threshold shares them on how far the vector is from the hyperplanes; both
are measured for every vector in every pass. Vectors whose chance to be missed in all passes is above what the recall
allows go through further passes with new hyperplanes. Once further windows would cost more than comparing what is left
of a label whole, that is done, in pairs of blocks.

The order is cut into blocks of ``BLOCK`` vectors by position, and the first ``WINDOW`` vectors of a block also close the
one before, so borders lose no pair and a label of any size is dealt out. Verified links are united over all passes, and
each united group is compared whole, dealt out in pairs of blocks; that counts every link inside it.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a
label, link with nothing; vectors of unlike lengths never link; copies link with each other; a null vec_id links with
nothing and has a null component; repeated rows count as copies; unlike vectors that share a vec_id are vectors of their
own, linked on their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from framestride.llm.groups import blocked, components, forest, map_groups
from framestride.operators import series as S
from framestride.operators.series import CHUNK
from framestride.session import stage

THRESHOLD, RECALL, WINDOW = 0.98, 0.9995, 128
#: Vectors of a block of the order, vectors compared with their windows at a time, hyperplanes of each half of a key.
BLOCK, STRIP, SIDES = 2048, 256, 63
PLACE = ["pass", "label", "dim"]


def agreement(threshold: float = THRESHOLD) -> float:
    """Probability that a pair at the threshold lies on the same side of a hyperplane."""
    return 1 - math.acos(threshold) / math.pi


def passes(largest: int, window: int = WINDOW, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold if ``largest`` vectors spread evenly; how they do spread is measured."""
    found = agreement(threshold) ** (max(0.0, math.log2(max(largest, 1) / window)) + 1) if largest > window else 1.0
    return 1 if found == 1.0 else math.ceil(math.log(1 - recall) / math.log(1 - found))


def _number(rows: DataFrame) -> type:
    """The type that vectors are kept in: that of the column if it is float, else double."""
    return np.float32 if getattr(rows.schema["embedding"].dataType, "elementType", None) == FloatType() else np.float64


def _clean(rows: DataFrame, number: type) -> DataFrame:
    """vec_id, label, dim and the vector's bytes; dim is null where the vector cannot link."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = [], []
            for v in batch.column(2).to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                x = np.array(v, number) + number(0) if ok else None  # + 0.0 makes -0.0 and 0.0 one value
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                dims.append(len(x) if ok else None)
                vectors.append(x.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "label", "dim", "vec"])

    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(clean, "vec_id long, label long, dim int, vec binary")


def _unit(column: pa.Array, dim: int, number: type) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), number).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@lru_cache(64)
def _planes(number: int, dim: int) -> np.ndarray:
    """The hyperplanes of a pass, one in a column."""
    return np.random.default_rng([number, dim]).standard_normal((dim, 2 * SIDES))


def leaves(x: np.ndarray, planes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The chance that a partner at the threshold, in a direction of its own, first differs from each unit vector by one
    of the sides 0..k: to a place behind the vector, and to a place before it."""
    t = x @ planes
    across = np.sqrt(np.maximum((planes * planes).sum(0) - t * t, 1e-12) / max(x.shape[1] - 1, 1))
    z = threshold * np.abs(t) / (math.sqrt(1 - threshold**2) * across)
    # The normal distribution function, to about 3e-4.
    kept = np.cumprod(0.5 + 0.5 * np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)), axis=1)
    first = -np.diff(kept, axis=1, prepend=1.0)
    return np.cumsum(np.where(t < 0, first, 0.0), axis=1), np.cumsum(np.where(t < 0, 0.0, first), axis=1)


def _hashed(classes: DataFrame, first: int, many: int, number: type) -> DataFrame:
    """cls, label, dim, pass and the two halves of the key, for ``many`` passes from ``first``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIDES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column(2).to_numpy()
            keys = np.zeros((2, len(dims), many), np.int64)
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                x = _unit(batch.column(3).take(pa.array(of)), dim, number)
                for k in range(many):
                    side = x @ _planes(first + k, dim) >= 0
                    keys[0, of, k], keys[1, of, k] = side[:, :SIDES] @ weights, side[:, SIDES:] @ weights
            repeated = pa.array(np.repeat(np.arange(len(dims)), many))
            columns = [c.take(repeated) for c in batch.columns[:3]] + [pa.array(np.tile(np.arange(first, first + many), len(dims))), pa.array(keys[0].ravel()), pa.array(keys[1].ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "label", "dim", "pass", "k1", "k2"])

    return classes.select("cls", "label", "dim", "vec").mapInArrow(add, "cls long, label long, dim int, pass long, k1 long, k2 long")


def _blocks(classes: DataFrame, first: int, many: int, window: int, number: type) -> DataFrame:
    """The vectors of each block of each pass in order, with the window behind the block."""
    keys = ["k1", "k2", "cls"]
    ordered = _hashed(classes, first, many, number).repartitionByRange(*PLACE, *keys)
    ordered = S.scan(stage(ordered.withColumn(CHUNK, F.spark_partition_id().cast("long"))), PLACE, keys, [S.position("pos")], chunked=True).drop(CHUNK)
    rows = max(BLOCK, window)
    own = F.floor(F.col("pos") / rows).cast("long")
    copies = F.array_compact(F.array(own, F.when((F.col("pos") % rows < window) & (own > 0), own - 1)))
    spots = ordered.groupBy("cls").agg(F.collect_list(F.struct("pass", "pos", "k1", "k2", own.alias("home"), copies.alias("blocks"))).alias("spots"))
    dealt = classes.join(spots, "cls").select("cls", "label", "dim", "vec", F.explode("spots").alias("spot"))
    return dealt.select("cls", "label", "dim", "vec", "spot.*").withColumn("block", F.explode("blocks")).drop("blocks")


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Leading sides that keys ``(half, row)`` share."""
    first, second = (SIDES - np.frexp((a ^ b).astype(np.float64))[1] for a, b in zip(one, two))
    return np.where(first < SIDES, first, SIDES + second)


def _windows(threshold: float, window: int, number: type):
    """Of each block: links ``(a, b)``, and for vectors ``a`` the chance that the pass misses a partner behind or before them."""
    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, dim, home, block, k1, k2, number_of = (table.column(c).to_numpy() for c in ("cls", "dim", "home", "block", "k1", "k2", "pass"))
        vectors = table.column("vec").combine_chunks()
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = stop - start
            x = _unit(vectors.slice(start, n), int(dim[start]), number)
            own = int(np.count_nonzero(home[start:stop] == block[start]))
            left, right = [], []
            for at in range(0, own, STRIP):
                end = min(at + STRIP, own)
                i, j = np.nonzero(x[at:end] @ x[at : end + window].T >= threshold)
                inside = (j > i) & (j <= i + window)
                left.append(i[inside] + at)
                right.append(j[inside] + at)
            low, high = forest(np.zeros(n, np.int64), np.concatenate(left), np.concatenate(right))
            ids, number_here = cls[start:stop], int(number_of[start])
            missed, before = np.zeros(own), np.arange(0)
            if n > window:
                # What two vectors a window apart share bounds the window behind the one and that before the other.
                i = np.arange(min(own, n - window))
                keys = np.stack([k1[start:stop], k2[start:stop]])
                shared = np.minimum(_shared(keys[:, i], keys[:, i + window]), 2 * SIDES - 1)
                behind, ahead = leaves(x, _planes(number_here, int(dim[start])), threshold)
                missed[i] = behind[i, shared]
                before = i + window
                missed = np.concatenate([missed, ahead[before, shared]])
            links = [pa.array(ids[high]), pa.array(ids[low]), pa.array(np.full(len(low), number_here)), pa.nulls(len(low), pa.float64())]
            rates = [pa.array(np.concatenate([ids[:own], ids[before]])), pa.nulls(len(missed), pa.int64()), pa.array(np.full(len(missed), number_here)), pa.array(missed)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(links, rates)], ["a", "b", "pass", "missed"])

    return compare


def _near(threshold: float, number: type):
    """Links ``(a, b)`` that join what the links of a pair of blocks join."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, own, dim = (table.column(c).to_numpy() for c in ("cls", "own", "dim"))
        vectors = table.column("vec").combine_chunks()
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = _unit(vectors.slice(start, stop - start), int(dim[start]), number)
            left, right = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            if len(left):
                low, high = forest(own[start:stop], left, right)
                yield pa.RecordBatch.from_arrays([pa.array(cls[start + high]), pa.array(cls[start + low])], ["a", "b"])

    return compare


def _links(classes: DataFrame, window: int, threshold: float, recall: float, number: type) -> DataFrame:
    """Links ``(a, b)`` of passes until the measured recall is reached, and of what is then left compared whole."""

    def largest(rows: DataFrame) -> int:
        return rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    edges = classes.sparkSession.createDataFrame([], "a long, b long")
    rates: DataFrame | None = None
    left, size, done = classes, largest(classes), 0
    while size > 1:
        many = passes(size, window, threshold, recall)
        found = stage(map_groups(_blocks(left, done, many, window, number), [*PLACE, "block"], _windows(threshold, window, number), "a long, b long, pass long, missed double", "pos"))
        edges = edges.union(found.where("b is not null").select("a", "b"))
        seen = found.where("b is null").groupBy("a", "pass").agg(F.log(F.greatest(F.sum("missed"), F.lit(1e-300))).alias("missed"))
        seen = seen.select(F.col("a").alias("cls"), "missed")
        rates = (seen if rates is None else rates.union(seen)).groupBy("cls").agg(F.sum("missed").alias("missed"))
        rates = stage(rates)
        done += many
        short = rates.where(F.exp("missed") > 1 - recall).select("cls")
        left = stage(classes.join(short, "cls", "left_semi"))
        size = largest(left)
        if 2 * done * window >= size:
            break
    if size > 1:
        sizes = left.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rest = blocked(left.join(sizes, ["label", "dim"]).withColumn("_of", F.xxhash64("label", "dim")), "_of", "n", "cls")
        edges = edges.union(map_groups(rest, ["label", "dim", "lo", "hi"], _near(threshold, number), "a long, b long"))
    return edges


def _inside(threshold: float, number: type):
    """Links of every vector of a pair of blocks, weighted by copies."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies, own, dim = (table.column(c).to_numpy() for c in ("cls", "copies", "own", "dim"))
        vectors = table.column("vec").combine_chunks()
        counts = np.zeros(len(ids), np.int64)
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = _unit(vectors.slice(start, stop - start), int(dim[start]), number)
            near = x @ x.T >= threshold
            side = own[start:stop]
            if side.min() != side.max():
                near &= side[:, None] != side[None, :]
            np.fill_diagonal(near, False)
            counts[start:stop] = near @ copies[start:stop]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["cls", "links"])

    return compare


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> DataFrame:
    """One row per vector: vec_id, n_links (vectors of its label linked directly), component_id, kept."""
    number = _number(rows)
    clean = stage(_clean(rows, number))
    usable = clean.where("vec_id is not null and label is not null and dim is not null")
    classes = usable.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()))
    united = stage(components(_links(classes, window, threshold, recall, number)))
    sizes = united.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = united.withColumnRenamed("node", "cls").join(sizes, "component").join(classes, "cls")
    links = map_groups(blocked(members, "component", "n", "cls"), ["component", "lo", "hi"], _inside(threshold, number), "cls long, links long")
    links = links.groupBy("cls").agg(F.sum("links").alias("links"))
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    united = united.join(least, "component").select(F.col("node").alias("cls"), "least")
    known = classes.join(links, "cls", "left").join(united, "cls", "left")
    known = known.select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = clean.withColumn("dim", F.when(F.col("vec_id").isNotNull(), F.col("dim"))).join(known, ["label", "dim", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
