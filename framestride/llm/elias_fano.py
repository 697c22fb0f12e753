"""Token-id files with Elias-Fano document boundaries.

One file holds the documents of one range of doc_id: the ids as little-endian 16-bit (or 32-bit) numbers one after the
other, then a footer with the number of documents, the ends of the documents and the doc_ids, both as Elias-Fano
sequences. A sequence of n values up to u takes about ``n * (2 + log2(u / n))`` bits; ``select`` finds the i-th value
through sampled positions of the unary part, so no table of 64-bit offsets exists in the file.

Files are written by the tasks under a name of their attempt, and only files named in the manifest (a table that
Spark commits) are read, so lost or repeated tasks leave no wrong data. The folder must be a store that pyarrow can
reach (a shared file system, HDFS, S3, GCS).

Null texts count as empty (the end id alone), null doc_ids come first, repeated rows are written once each in order of
their text, other columns are not read. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framestride.llm.bpe import encoder, tokenizer_path
from framestride.llm.packing import with_end
from framestride.session import checkpoint_dir, stage

MAGIC, END, SAMPLE = b"IDSEF001", 2, 256
#: Ids that are read from a file at a time.
READ_IDS = 1 << 20

MANIFEST = "shard int, file string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of numbers in 0..2**64-1."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        lows = np.zeros(0, np.uint8)
        if bits and n:
            digits = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(digits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(n, bits, lows, np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype("<u4" if n == 0 or ones[-1] < 1 << 32 else "<u8"))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        start = first * self.low_bits
        stop = last * self.low_bits
        digits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (digits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled position before it, at most ``SAMPLE`` ones are passed."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last``, the last not included."""
        last = min(last, self.n)
        if first >= last:
            return np.zeros(0, np.uint64)
        at = int(self.samples[first // SAMPLE])
        skip = first % SAMPLE
        stop = last + SAMPLE - 1
        until = int(self.samples[stop // SAMPLE]) if stop // SAMPLE < len(self.samples) else len(self.high) * 8 - 1
        bits = np.unpackbits(self.high[at // 8 : until // 8 + 1], bitorder="little")[at % 8 :]
        ones = np.flatnonzero(bits)[skip : skip + last - first] + at
        high = (ones - np.arange(first, last)).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._lows(first, last)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    def header(self) -> list[int]:
        return [self.n, self.low_bits, self.samples.dtype.itemsize, *map(len, self.parts())]

    @classmethod
    def read(cls, header: list[int], data: memoryview) -> EliasFano:
        n, bits, width, low, high, samples = header
        return cls(
            n,
            bits,
            np.frombuffer(data[:low], np.uint8),
            np.frombuffer(data[low : low + high], np.uint8),
            np.frombuffer(data[low + high : low + high + samples], f"<u{width}"),
        )


def write_shard(store: fs.FileSystem, path: str, documents: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """Write one file from ``(doc_ids, counts, ids)`` in order; returns the number of documents and ids."""
    names: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    nulls = 0
    with store.open_output_stream(path) as out:
        out.write(MAGIC)
        for ids, sizes, tokens in documents:
            nulls += sum(i is None for i in ids)
            names.append(np.array([i for i in ids if i is not None], np.int64))
            counts.append(sizes)
            out.write(tokens.astype(f"<u{width}").tobytes())
        known = np.concatenate([np.zeros(0, np.int64), *names])
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))
        base = int(known[0]) if len(known) else 0
        sequences = [EliasFano.encode(ends), EliasFano.encode(known.view(np.uint64) - np.uint64(base % (1 << 64)))]
        footer = json.dumps({"width": width, "nulls": nulls, "base": base, "ends": sequences[0].header(), "docs": sequences[1].header()}).encode()
        body = b"".join(p for s in sequences for p in s.parts())
        out.write(body + footer + struct.pack("<QQ", len(body), len(footer)) + MAGIC)
    return len(ends), int(ends[-1]) if len(ends) else 0


class Shard:
    """An open file: ``offsets`` and ``ids`` of any range of its documents."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        if self.file.read_at(8, 0) != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{path} is not a token-id file")
        body, footer = struct.unpack("<QQ", tail[:16])
        meta = json.loads(self.file.read_at(footer, size - 24 - footer))
        data = memoryview(self.file.read_at(body, size - 24 - footer - body))
        self.width, self.nulls, self.base = meta["width"], meta["nulls"], meta["base"]
        self.ends = EliasFano.read(meta["ends"], data)
        self.names = EliasFano.read(meta["docs"], data[sum(meta["ends"][3:]) :])
        self.n = self.ends.n

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Starts of documents first..last-1 and the end of the last of them."""
        before = [0] if first == 0 else []
        return np.concatenate([np.array(before, np.int64), self.ends.slice(max(first - 1, 0), last).astype(np.int64)])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        known = self.names.slice(max(first - self.nulls, 0), max(last - self.nulls, 0)) + np.uint64(self.base % (1 << 64))
        return [None] * max(0, min(last, self.nulls) - first) + known.view(np.int64).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, 8 + start * self.width), f"<u{self.width}")


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order; returns the committed manifest of the files."""
    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get()

        def documents():
            for batch in batches:
                names = batch.column(0).to_pylist()
                for first, last, ids, counts in encode.column(batch.column(1)):
                    yield names[first:last], counts + 1, with_end(ids, counts, end)

        name = f"ids-{task.partitionId():06d}-{uuid.uuid4().hex}.ef"
        width = 2 if max(encode.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        n_docs, n_ids = write_shard(store, f"{root}/{name}", documents(), width)
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]}
            )
        else:
            store.delete_file(f"{root}/{name}")

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    return stage(ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(write, MANIFEST))


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start among all ids, number of ids, checksum."""
    # One row per file; the running total over files is the only thing that is ordered as a whole.
    placed = manifest.withColumn("_base", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).select("file", "_base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store, f"{root}/{row['file']}")
                first = 0
                while first < shard.n:
                    start = shard.ends.select(first - 1) if first else 0
                    last = _until(shard, first, start + READ_IDS)
                    bounds = shard.offsets(first, last)
                    ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    cuts = (bounds - bounds[0]).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.doc_ids(first, last), pa.int64()),
                        "start": pa.array(bounds[:-1] + row["_base"]),
                        "n_tokens": pa.array(np.diff(bounds)),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    })
                    first = last

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, ROWS)


def _until(shard: Shard, first: int, most: int) -> int:
    """The document after the last that ends by id ``most``; one document at least."""
    low, high = first + 1, shard.n
    while low < high:
        middle = (low + high + 1) // 2
        if shard.ends.select(middle - 1) <= most:
            low = middle
        else:
            high = middle - 1
    return low


def token_ids(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Write the ids of all documents below the checkpoint folder and read them back."""
    folder = f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(docs, folder, path, end), folder)


