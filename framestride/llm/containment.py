"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity, so one signature length cannot serve all documents.
Documents are partitioned by the power of two of their number of distinct shingles, and the signature has that many
bins times ``2**step``: one-permutation min-hashing keeps the smallest hash of each bin. An item's shared shingle is the
smallest of its bin with probability of at least ``(1 - exp(-load)) / load``, load ``2**-step``; items are partitioned
by the step that reaches the target recall for the number of shingles they must share, and items too short for any step
are searched with all their shingles. A pair that agrees in one bin is verified: shared shingles / shingles of the item.

The items are the query set. Their shingles are written once below the checkpoint folder in blocks of bounded size, tasks
read one block at a time, and each block meets all documents in one pass without a shuffle; only the blocks' numbers pass
through the driver.

Defined results: null or empty texts and items match nothing, nor does an item of fewer than five words whose words are not a document's
whole text; null ids are kept as they are; repeated rows give repeated pairs. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.llm.text import U, distinct, shingles, word_batches
from framestride.session import checkpoint_dir, stage

THRESHOLD, RECALL = 0.8, 0.9999
#: Steps of the signature length that are tried; shingles of the items of one block.
STEPS, BLOCK_SHINGLES = 4, 1 << 20

PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def step_for(size: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The smallest step whose signature finds an item of ``size`` shingles with the target recall; -1: none does."""
    need = math.ceil(threshold * size - 1e-9)
    for step in range(STEPS + 1):
        load = 2.0**-step
        if (1 - (1 - math.exp(-load)) / load) ** need <= 1 - recall:
            return step
    return -1


class Items:
    """A block of items: their shingles in order, with what the search needs of each."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float, recall: float):
        self.ids = np.array(ids, object)
        self.threshold = threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate([np.zeros(0, U), *sets])
        item = np.repeat(np.arange(len(sets)), self.size)
        before = np.concatenate([np.zeros(1, U), values[:-1]])
        first = np.ones(len(values), bool)
        first[1:] = item[1:] != item[:-1]
        step = np.array([step_for(len(s), threshold, recall) for s in sets], np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.item, self.before, self.first = values[order], item[order], before[order], first[order]
        self.step = step[self.item]

    def match(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position in values, posting)`` of every value that some item has."""
        low = np.searchsorted(self.values, values)
        low[low == len(self.values)] = 0
        hit = np.flatnonzero(self.values[low] == values)
        low = low[hit]
        high = np.searchsorted(self.values, values[hit], "right")
        size = high - low
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(hit, size), np.repeat(low, size) + inside

    def pairs(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, item, shared)`` of rows of distinct sorted shingles that contain an item."""
        none = np.zeros(0, np.int64)
        if not len(values) or not len(self.values):
            return none, none, none
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(len(sizes)), sizes)
        level = np.frexp(np.maximum(sizes, 1).astype(float))[1]  # sizes are below 2**level
        head = np.zeros(len(values), bool)
        head[bounds[:-1][sizes > 0]] = True
        before = np.concatenate([np.zeros(1, U), values[:-1]])

        def smallest(v: np.ndarray, b: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
            shift = (64 - bits).astype(np.uint64)
            return first | (v >> shift != b >> shift)

        # The signature with most bins holds those with fewer.
        signed = np.arange(len(values))
        if (self.step >= 0).all():
            signed = np.flatnonzero(smallest(values, before, head, level[row] + int(self.step.max())))
        at, posting = self.match(values[signed])
        at = signed[at]
        bits = level[row[at]] + self.step[posting]
        agree = smallest(values[at], before[at], head[at], bits) & smallest(self.values[posting], self.before[posting], self.first[posting], bits)
        agree |= self.step[posting] < 0
        asked = np.unique(row[at[agree]] * len(self.size) + self.item[posting[agree]])
        if not len(asked):
            return none, none, none
        # Exact containment of the pairs found.
        rows = np.unique(asked // len(self.size))
        inside = np.isin(row, rows)
        at, posting = self.match(values[inside])
        keys, shared = np.unique(row[inside][at] * len(self.size) + self.item[posting], return_counts=True)
        keep = np.isin(keys, asked, assume_unique=True)
        keys, shared = keys[keep], shared[keep]
        item = keys % len(self.size)
        keep = shared >= self.threshold * self.size[item] - 1e-9
        return (keys // len(self.size))[keep], item[keep], shared[keep]


def item_sets(items: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in word_batches(batch.column(1)):
                values, bounds = distinct(*shingles(words), last - first)
                cuts = bounds.tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(bounds)), pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["item_id", "n", "set"],
                )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(build, "item_id long, n long, set binary").where("n > 0")


@dataclass(frozen=True)
class Block:
    """A block of written items; a process keeps the one it read last."""

    folder: str
    number: int
    threshold: float
    recall: float

    def load(self) -> Items:
        return _load(self)


@lru_cache(1)
def _load(block: Block) -> Items:
    store, root = fs.FileSystem.from_uri(f"{block.folder}/block={block.number}")
    ids: list = []
    sets: list[np.ndarray] = []
    for info in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                rows = pq.ParquetFile(file).read(["item_id", "set"])
            ids += rows.column(0).to_pylist()
            sets += [np.frombuffer(s, np.uint64) for s in rows.column(1).to_pylist()]
    return Items(ids, sets, block.threshold, block.recall)


def blocks(items: DataFrame, threshold: float, recall: float, most: int = BLOCK_SHINGLES) -> list[Block]:
    """Write the items in blocks of about ``most`` shingles."""
    sets = stage(item_sets(items))
    number = -(-(sets.agg(F.sum("n")).first()[0] or 0) // most)
    folder = f"{checkpoint_dir(items.sparkSession).rstrip('/')}/items-{uuid.uuid4().hex}"
    if number:
        dealt = sets.withColumn("block", F.pmod(F.xxhash64("item_id", "set"), F.lit(number)))
        dealt.repartition("block").write.partitionBy("block").parquet(folder)
    return [Block(folder, k, threshold, recall) for k in range(number)]


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold`` of the distinct shingles."""
    source = docs.select(F.col("doc_id").cast("long"), "text")
    found = docs.sparkSession.createDataFrame([], PAIRS)
    for block in blocks(items, threshold, recall):
        found = found.union(source.mapInArrow(_searcher(block), PAIRS))
    return found


def _searcher(of: Block):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = of.load()
        for batch in batches:
            for first, last, words in word_batches(batch.column(1)):
                row, item, shared = block.pairs(*distinct(*shingles(words), last - first))
                if len(row):
                    size = block.size[item]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(block.ids[item].tolist(), pa.int64()), pa.array(size), pa.array(shared), pa.array(shared / size)],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

    return search


def is_contaminated(text: Column, items: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> Column:
    """Whether a text contains an item: false for null texts. Rows and other columns stay as they are."""
    found = F.lit(False)
    for block in blocks(items, threshold, recall):
        found = found | _flag(block)(text)
    return found


def _flag(of: Block):
    @F.arrow_udf("boolean")
    def flag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = of.load()
        for column in batches:
            out = np.zeros(len(column), bool)
            for first, last, words in word_batches(column):
                row, _, _ = block.pairs(*distinct(*shingles(words), last - first))
                out[first + row] = True
            yield pa.array(out)

    return flag
