"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so best fit decreasing depends on the number of pieces of each length
alone, and open bins with the same remaining capacity are alike. The plan is made on the driver from the histogram of
lengths (at most ``capacity`` rows, whatever the corpus holds): lengths go down, a segment tree over the remaining
capacities finds the tightest open bins, and bins of one history are kept as one group with a multiplicity. Pieces then
find their place by their rank among the pieces of their length, which Spark counts per task and sums over tasks.

Null or empty texts give a document of the end id alone; repeated rows are packed once each; an empty table gives an
empty table. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framestride.llm.bpe import encoder, tokenizer_path
from framestride.session import arrow_rows, stage

CAPACITY, END = 2048, 0
#: Texts of an Arrow batch.
TEXTS_AT_ONCE = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Tightest:
    """Segment tree over remaining capacities; finds the smallest one that holds a group of open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.full = [False] * (2 * self.size)

    def put(self, room: int, full: bool) -> None:
        at = room + self.size
        self.full[at] = full
        while at > 1:
            at >>= 1
            self.full[at] = self.full[2 * at] or self.full[2 * at + 1]

    def find(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` with an open bin."""
        at = least + self.size
        if not self.full[at]:
            while at > 1 and not (at % 2 == 0 and self.full[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.full[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Where the pieces of each length go, by their rank among the pieces of that length.

    Rows: length, first rank, items per bin, first bin, offset of the first item. A rank ``r`` of the row lies in bin
    ``bin + (r - first) // per_bin`` at ``offset + (r - first) % per_bin * length``.
    """
    open_: dict[int, list[tuple[int, tuple]]] = {}
    tree = Tightest(capacity)
    done: list[tuple[int, tuple]] = []

    def put(room: int, number: int, items: tuple) -> None:
        if room == 0:
            done.append((number, items))
            return
        open_.setdefault(room, []).append((number, items))
        tree.put(room, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            room = tree.find(length)
            if room is None:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, left // each, ((length, each),))
                if left % each:
                    put(capacity - left % each * length, 1, ((length, left % each),))
                break
            number, items = open_[room].pop()
            if not open_[room]:
                tree.put(room, False)
            each = room // length
            used = min(number, left // each)
            rest = min(left - used * each, each) if used < number else 0
            if used:
                put(room - each * length, used, (*items, (length, each)))
            if rest:
                put(room - rest * length, 1, (*items, (length, rest)))
            if number - used - (rest > 0):
                put(room, number - used - (rest > 0), items)
            left -= used * each + rest
    groups = done + [g for groups in open_.values() for g in groups]
    rows, taken, bins = [], dict.fromkeys(counts, 0), 0
    for number, items in groups:
        offset = 0
        for length, each in items:
            rows.append((length, taken[length], each, bins, offset))
            taken[length] += number * each
            offset += length * each
        bins += number
    return pd.DataFrame(rows, columns=["length", "first", "per_bin", "bin", "offset"]).astype("int64").sort_values(["length", "first"], ignore_index=True)


def pack(rows: DataFrame, length: str = "length", capacity: int = CAPACITY, make=None, made: str | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows whose ``length`` lies in 1..capacity, as few sequences as best fit needs.

    ``make`` turns Arrow batches of ``rows`` into those to pack, of schema ``made``, in the same pass. Columns of the
    input with the added names are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("sequence_id", "offset", "_task", "_rank", "_before") if make is None else rows
    kept = (rows.schema if made is None else T.StructType.fromDDL(made)).fields
    schema = T.StructType([*kept, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number the rows of each length within the task."""
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches if make is None else make(batches):
            sizes = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(sizes) == 0:
                continue
            order = np.argsort(sizes, kind="stable")
            inside = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order])
            rank = np.empty(len(sizes), np.int64)
            rank[order] = inside + seen[sizes[order]]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), task, np.int32)), pa.array(rank)], [*batch.schema.names, "_task", "_rank"]
            )

    with arrow_rows(spark, TEXTS_AT_ONCE):
        rows = stage(rows.mapInArrow(ranked, schema))
    counts = rows.groupBy("_task", F.col(length).alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    totals = {int(r["_length"]): int(r["_n"]) for r in counts.groupBy("_length").agg(F.sum("_n").alias("_n")).collect()}
    places = plan(totals, capacity)
    # One row per task and length: at most as many as the rows, and bounded by tasks * capacity.
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ).select(F.col("_task").alias("_t"), "_length", "_before")
    # The counts of a partition are a small table; a merge join would sort all pieces, in pages that a task holds for each sort.
    joined = rows.join(before.hint("shuffle_hash"), (rows["_task"] == before["_t"]) & (rows[length] == before["_length"])).drop("_t", "_length")
    out = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    table = {c: places[c].to_numpy() for c in places.columns}
    key = table["length"] << 44 | table["first"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sizes = frame[length].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = frame.pop("_rank").to_numpy() + frame.pop("_before").to_numpy()
            frame.pop("_task")
            row = np.searchsorted(key, sizes << 44 | rank, "right") - 1
            past = rank - table["first"][row]
            each = table["per_bin"][row]
            frame["sequence_id"] = pa.array(table["bin"][row] + past // each)
            frame["offset"] = pa.array(table["offset"][row] + past % each * sizes)
            yield pa.RecordBatch.from_arrays([frame[n] for n in out.names], out.names)

    if not totals:
        return spark.createDataFrame([], out)
    return joined.mapInArrow(placed, out)


def cutter(path: str, capacity: int = CAPACITY, end: int = END):
    """Turns batches of doc_id and text into token pieces: whole texts with an end id, cut where they are longer than the
    capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            names = batch.column(0)
            for first, last, ids, counts in encode.column(batch.column(1)):
                whole = with_end(ids, counts, end)
                counts = counts + 1
                parts = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                size = np.minimum(counts[row] - start, capacity)
                at = np.repeat(np.cumsum(counts) - counts, parts) + start
                crc = [zlib.crc32(whole[a : a + s]) for a, s in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, last - first).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return cut


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Ids of texts, concatenated, with an end id after each text (little-endian 32-bit)."""
    out = np.full(len(ids) + len(counts), end, "<u4")
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return pack(texts, "length", capacity, cutter(path or tokenizer_path(), capacity, end), PIECES)
