"""Groups that may be hot: dealing them out in blocks, reading them whole in a task, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.session import stage

#: Rows of a block: at least / at most, and the number of blocks up to which smaller blocks are preferred.
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 32, 1024, 24


def blocked(df: DataFrame, group: str, size: str, ident: str, least: int = BLOCK_LEAST) -> DataFrame:
    """Deal groups out in pairs of blocks, so that any two rows of a group meet in one pair and no task gets a whole hot group.

    Adds ``lo``, ``hi`` (the pair) and ``own`` (the row's block); two rows are to be compared in the pair of their
    blocks, so in a pair with ``lo != hi`` only across. Blocks hold ``least`` rows or more; a group of n rows is copied at
    most max(min(24, n / least), n / 1024) times.
    """
    n = F.greatest(F.least(F.lit(BLOCKS), F.ceil(F.col(size) / least)), F.ceil(F.col(size) / BLOCK_MOST)).cast("int")
    own = F.pmod(F.xxhash64(F.col(ident), F.col(group)), n).cast("int")
    dealt = df.withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by integer ``keys``: tables of whole groups, with the bounds of the groups."""
    held: list[pa.RecordBatch] = []
    last = None

    def made(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        at = _changes(table, keys)
        return table, np.concatenate([[0], at, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        changes = _changes(pa.Table.from_batches([batch]), keys)
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        if last is not None and first != last:
            changes = np.concatenate([[0], changes])
        last = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
        if len(changes):
            cut = int(changes[-1])
            ready = [*held, batch.slice(0, cut)] if cut else held
            if ready:
                yield made(ready)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield made(held)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        v = table.column(k).to_numpy()
        changed |= v[1:] != v[:-1]
    return np.flatnonzero(changed) + 1


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema, *order: str) -> DataFrame:
    """Apply ``fn(table, bounds)`` to tables of whole groups, their rows in ``order``; a task holds one batch and one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, keys):
            yield from fn(table, bounds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches through the links ``left[k] - right[k]``."""
    label = np.arange(n)
    while True:
        old = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = np.minimum(label, label[label])
        if (label == old).all():
            return label


def forest(own: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links ``(low, high)`` that join what the links of a pair of blocks join.

    In a block's pair with itself each position is linked to the first it reaches. In a pair of two blocks what hangs
    together within one block counts as joined already, so only its first position is linked: a dense group of k blocks
    gives about one link per row and one per pair, not one per row and pair.
    """
    n = len(own)
    root = roots(n, left, right)
    if own.min() == own.max():
        high = np.flatnonzero(root != np.arange(n))
        return root[high], high
    same = own[left] == own[right]
    within = roots(n, left[same], right[same])
    high = np.flatnonzero((within == np.arange(n)) & (root != np.arange(n)))
    return root[high], high


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the graph of ``(a, b)``: component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours move to its smallest neighbour until only
    stars remain, in about log(diameter) rounds. Every round is a table in the checkpoint folder, so a lost executor
    costs one round. Hot nodes are reduced by a minimum first and joined back, never collected.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        moved = large.join(least, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        now = stage(moved.union(least.select("u", "_m")).distinct())
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
