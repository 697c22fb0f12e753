"""Hard negatives by branch and bound on vertical blocks (BOND).

Vectors lie in blocks of at most ``BLOCK`` rows of one label, one column per dimension, with the least and largest value
of each. An anchor reads a block's columns in descending order of its own magnitudes. After every few columns the least
and most that the remaining ones can add are known for all rows of the block, so a row whose score cannot reach what is
asked for leaves the candidate bitmap, and later columns are read for the rest only. Scores of what remains are exact.

Two rounds: among rows of its own label an anchor asks for its ``positives`` highest scores, among the others for the
``negatives`` highest scores within the window ``low * positive <= 100 * negative <= high * positive`` of each positive.
Both keep what earlier blocks of the task gave as a bound.

Blocks are cut from ranges of rows, so a label may hold any share of them. Anchors are written once as blocks; a task
reads them one block at a time from the shared folder, so nothing passes through the driver. A task gives a bounded
number of rows per anchor, which are ranked per anchor afterwards.

Defined results: rows with a null vec_id, label or vector or with a null or non-finite component take no part, nor do
those whose scaled components exceed ``LIMIT``, whose products may leave 64 bits; vectors of unlike lengths never meet;
repeated rows count once, and rows that share a vec_id with an anchor are not its partners; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framestride.session import checkpoint_dir, stage

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 3, 50, 95
#: Rows and components of a block of vectors, at most; anchors of a block; columns read between two looks at the bounds.
BLOCK, CELLS, ANCHORS, STEP = 4096, 1 << 19, 512, 8
#: Components of the blocks that a task scans together.
HELD = 1 << 23
LIMIT = float(1 << 26)
_EXACT = float(1 << 53)
VECTORS = "vec_id long, label long, dim int, vec binary"


def _scaled(rows: DataFrame) -> DataFrame:
    """Distinct vec_id, label and vector as 32-bit whole numbers of the rows that take part."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vectors = [], []
            for v in batch.column(2).to_pylist():
                x = None if v is None or None in v else np.floor(np.array(v, np.float64) * SCALE) + 0.0
                ok = x is not None and bool(np.isfinite(x).all()) and bool((np.abs(x) <= LIMIT).all())
                dims.append(len(x) if ok else None)
                vectors.append(x.astype(np.int32).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "label", "dim", "vec"])

    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and label is not null")
    return rows.mapInArrow(scale, VECTORS).where("dim is not null").distinct()


def _blocks(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors in blocks of one label and length: label, dim, n, ids and the matrix, a column per vector dimension."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        parts: list[bytes] = []
        now = None

        def block() -> pa.RecordBatch:
            matrix = np.frombuffer(b"".join(parts), np.int32).reshape(len(ids), now[1])
            columns = [[now[0]], [now[1]], [len(ids)], [np.array(ids, np.int64).tobytes()], [np.ascontiguousarray(matrix.T).tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "dim", "n", "ids", "columns"])

        for batch in batches:
            for ident, label, dim, vec in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ids and (now != (label, dim) or len(ids) == max(1, min(most, CELLS // max(dim, 1)))):
                    yield block()
                    ids, parts = [], []
                now = label, dim
                ids.append(ident)
                parts.append(vec)
        if ids:
            yield block()

    sorted_ = vectors.repartitionByRange("label", "dim", "vec_id", "vec").sortWithinPartitions("label", "dim", "vec_id")
    return sorted_.mapInArrow(cut, "label long, dim int, n int, ids binary, columns binary")


class Block:
    """A vertical block: ids, the matrix (dimension, row) and the bounds of each dimension."""

    def __init__(self, row: dict):
        self.label, self.dim = row["label"], row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.columns = np.frombuffer(row["columns"], np.int32).reshape(self.dim, len(self.ids)).astype(np.float64)
        self.least, self.most = self.columns.min(1, initial=np.inf), self.columns.max(1, initial=-np.inf)
        self.largest = max(1.0, float(np.abs(self.columns).max(initial=0.0)))


class Scan:
    """An anchor's scan of a block: scores so far, and what the unread columns can add at least and at most."""

    def __init__(self, anchor: np.ndarray, block: Block):
        self.block, self.order = block, np.argsort(-np.abs(anchor), kind="stable")
        self.weights = anchor[self.order]
        one, two = self.weights * block.least[self.order], self.weights * block.most[self.order]
        self.after_least = np.append(np.cumsum(np.minimum(one, two)[::-1])[::-1], 0.0)
        self.after_most = np.append(np.cumsum(np.maximum(one, two)[::-1])[::-1], 0.0)
        # Sums of whole numbers are exact in floats below 2**53, and in 64-bit integers beyond.
        self.exact = float(np.abs(anchor).max(initial=0.0)) * block.largest * max(block.dim, 1) < _EXACT

    def run(self, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block that are left, and their scores. ``keep(least, most, rows)`` tells which stay."""
        if not self.exact:
            rows = np.arange(len(self.block.ids))
            return rows, self.weights.astype(np.int64) @ self.block.columns[self.order].astype(np.int64)
        rows, columns = None, self.block.columns
        scores = np.zeros(len(self.block.ids))
        for k in range(0, len(self.order), STEP):
            read = self.order[k : k + STEP]
            scores += self.weights[k : k + STEP] @ (columns[read] if rows is None else columns[np.ix_(read, rows)])
            at = min(k + STEP, len(self.order))
            stay = keep(scores + self.after_least[at], scores + self.after_most[at], rows)
            left = int(np.count_nonzero(stay))
            if left == 0:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            # The bitmap is applied once it pays.
            if left * 4 <= len(stay) * 3 or at == len(self.order):
                rows = np.flatnonzero(stay) if rows is None else rows[stay]
                scores = scores[stay]
        return (np.arange(len(scores)) if rows is None else rows), scores.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, or minus infinity."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class Best:
    """The first ``k`` of (score, vec_id): higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def bound(self) -> float:
        """A score that one of the first k must reach."""
        return self.heap[0][0] if len(self.heap) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(ids) > self.k:
            first = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[first], ids[first]
        for item in zip(scores.tolist(), (-ids).tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)


def highest(anchor: np.ndarray, ident: int, block: Block, best: Best) -> None:
    """Offer the rows of a block to an anchor's highest scores."""
    other = block.ids != ident

    def keep(least: np.ndarray, most: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        among = other if rows is None else other[rows]
        return among & (most >= max(best.bound(), _kth(least[among], best.k)))

    rows, scores = Scan(anchor, block).run(keep)
    found = other[rows]
    best.add(scores[found], block.ids[rows][found])


def windows(positives: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """For each positive score the least and largest score ``s`` with ``low * positive <= 100 * s <= high * positive``."""
    return [(-(-low * p // 100), high * p // 100) for p in positives]


def within(anchor: np.ndarray, ident: int, block: Block, bounds: list[tuple[int, int]], best: list[Best]) -> None:
    """Offer the rows of a block to the windows of an anchor."""
    other = block.ids != ident

    def keep(least: np.ndarray, most: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        among = other if rows is None else other[rows]
        stay = np.zeros(len(least), bool)
        for (low, high), of in zip(bounds, best):
            if low <= high:
                sure = among & (least >= low) & (most <= high)
                stay |= (most >= max(low, of.bound(), _kth(least[sure], of.k))) & (least <= high)
        return stay & among

    rows, scores = Scan(anchor, block).run(keep)
    ids, found = block.ids[rows], other[rows]
    for (low, high), of in zip(bounds, best):
        inside = found & (scores >= low) & (scores <= high)
        of.add(scores[inside], ids[inside])


def _write_anchors(anchors: DataFrame, folder: str) -> None:
    """Anchors as files of row groups of ``ANCHORS`` rows."""
    anchors.write.option("parquet.block.row.count.limit", str(ANCHORS)).parquet(folder)


def _anchors(folder: str) -> Iterator[list[dict]]:
    """Blocks of anchors, read one at a time."""
    store, root = fs.FileSystem.from_uri(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(ANCHORS):
                    yield batch.to_pylist()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Block]]:
    """The blocks of a task, ``HELD`` components at a time."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            block = Block(batch.slice(k, 1).to_pylist()[0])
            if held and size + block.columns.size > HELD:
                yield held
                held, size = [], 0
            held.append(block)
            size += block.columns.size
    if held:
        yield held


def _search(blocks: DataFrame, folder: str, schema: str, offer) -> DataFrame:
    """Scan all blocks for all anchors: ``offer(anchor, vector, blocks)`` yields the rows a task gives for an anchor."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for anchors in _anchors(folder):
                rows = [row for a in anchors for row in offer(a, np.frombuffer(a["vec"], np.int32).astype(np.float64), held)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return blocks.mapInArrow(run, schema)


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows where ``anchors`` holds: anchor_id, positive_id, rank, negative_id and both scores."""
    vectors = stage(_scaled(rows))
    blocks = stage(_blocks(vectors, BLOCK))
    root = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/anchors-{uuid.uuid4().hex}"
    asked = vectors.where(anchors).withColumn("anchor", F.monotonically_increasing_id())
    _write_anchors(asked, f"{root}/all")
    asked = rows.sparkSession.read.schema("vec_id long, label long, dim int, vec binary, anchor long").parquet(f"{root}/all")

    def positive(a: dict, vector: np.ndarray, held: list[Block]) -> Iterator[tuple]:
        best = Best(positives)
        for block in held:
            if block.label == a["label"] and block.dim == a["dim"]:
                highest(vector, a["vec_id"], block, best)
        return ((a["anchor"], score, -ident) for score, ident in best.heap)

    found = stage(_first(_search(blocks, f"{root}/all", "anchor long, score long, found long", positive), ["anchor"], positives))
    scores = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    _write_anchors(asked.join(scores, "anchor"), f"{root}/scored")

    def negative(a: dict, vector: np.ndarray, held: list[Block]) -> Iterator[tuple]:
        bounds = windows(a["scores"], low, high)
        best = [Best(negatives) for _ in bounds]
        for block in held:
            if block.label != a["label"] and block.dim == a["dim"]:
                within(vector, a["vec_id"], block, bounds, best)
        return ((a["anchor"], k + 1, score, -ident) for k, of in enumerate(best) for score, ident in of.heap)

    near = _search(blocks, f"{root}/scored", "anchor long, positive long, score long, found long", negative)
    near = _first(near, ["anchor", "positive"], negatives)
    found = found.select("anchor", F.col("rank").cast("long").alias("positive"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = near.join(found, ["anchor", "positive"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows with the next label where vec_id is divisible by ``every``."""
    label = F.col("label").cast("long")
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label))
