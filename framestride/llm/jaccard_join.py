"""Chosen-path Jaccard join of word shingles.

Each distinct shingle set is embedded as 128 min-hash tokens. A run walks a tree of chosen paths: a node picks one of
the 128 tokens, and with probability ``1 / threshold - 1`` a second one, from its own hash alone; sets that share the
value of a picked token go on together. A pair at the threshold keeps one common child on average at every level, so it
survives to a leaf with a known probability, and runs are repeated until the target recall. Leaves of few sets are
compared all against all; a leaf that stays large is split further, and at the last level it is compared in pairs of
blocks, so nothing is capped.

Leaves compare 256-bit sketches loosely. The sets that hang together loosely are then compared exactly, each group in
pairs of blocks, which finds every link within the group and counts it.

Defined results: a text of one to four words has one shingle of all its words; a text without words (null, empty)
links with nothing and is its own class; a null doc_id links with nothing and has null class and component; repeated
rows count as copies of each other; rows that share a doc_id are one document. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framestride.llm.groups import blocked, components, forest, map_groups
from framestride.llm.text import U, distinct, mix, shingles, word_batches
from framestride.session import stage

THRESHOLD, RECALL = 0.8, 0.9995
TOKENS = 128
#: Levels before leaves are counted, levels at most, and sets of a leaf that is split no further.
DEPTH, DEEPEST, LEAF = 2, 4, 256
#: Sets of a block of a leaf that stays large: sketches are small, so few large blocks copy less.
LEAF_BLOCK = 512
#: Standard deviations of the sketch's estimate below the threshold that still count as loosely similar.
SLACK = 4.0
#: Rows up to which the list of documents to compare exactly is sent to every executor; a shuffle join beyond.
BROADCAST_ROWS = 1_000_000

_ROW = np.arange(TOKENS, dtype=np.uint64)
_A = (mix(_ROW * U(0x9E3779B97F4A7C15) + U(11)) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(_ROW * U(0xC2B2AE3D27D4EB4F) + U(13)) >> U(32)).astype(np.uint32)


def survival(depth: int, threshold: float, agree: float | None = None) -> float:
    """Probability that a pair whose tokens agree to a share of ``agree`` (default: the threshold) shares a node at the
    given depth of one run."""
    more = 1 / threshold - 1
    agree = threshold if agree is None else agree
    alive = 1.0
    for _ in range(depth):
        hit = agree * alive
        alive = (1 - more) * hit + more * (1 - (1 - hit) ** 2)
    return alive


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def reached(number: int, threshold: float = THRESHOLD) -> float:
    """Recall of ``number`` runs for pairs at the threshold.

    All runs and the sketches come from the same tokens, so it is averaged over how many of them agree.
    """
    least, total = _least(threshold), 0.0
    for k, share in enumerate(_binomial(TOKENS, threshold)):
        sketched = sum(_binomial(TOKENS - k, 0.25)[max(0, least - k) :])
        total += share * sketched * (1 - (1 - survival(DEEPEST, threshold, k / TOKENS)) ** number)
    return total


def runs(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs that reach the target recall for pairs at the threshold."""
    best = reached(1 << 20, threshold)
    if best < recall:
        raise ValueError(f"{TOKENS} tokens reach a recall of {best:.5f} at most")
    return next(n for n in range(1, 1 << 20) if reached(n, threshold) >= recall)


def _least(threshold: float) -> int:
    """Tokens whose sketch bits are equal, at least, in loosely similar sets."""
    agree = threshold + (1 - threshold) / 4
    return math.floor(TOKENS * (agree - SLACK * math.sqrt(agree * (1 - agree) / TOKENS)))


def _min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 min-hash values (uint32) of each non-empty set."""
    short = (values >> U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, TOKENS), np.uint32)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + 8192, "right")) - 1)
        last = min(last, len(out))
        if last == first + 1:
            least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
            for at in range(int(bounds[first]), int(bounds[last]), 8192):
                least = np.minimum(least, (short[at : min(at + 8192, bounds[last]), None] * _A + _B).min(0))
            out[first] = least
        else:
            block = short[bounds[first] : bounds[last], None] * _A + _B
            out[first:last] = np.minimum.reduceat(block, bounds[first:last] - bounds[first], axis=0)
        first = last
    return out


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each token: 32 bytes a set. The bits are mixed, as low bits of minima are not even."""
    two = (mix(tokens.astype(np.uint64)) & U(3)).astype(np.uint8)
    pairs = np.stack([two >> 1, two & 1], -1).reshape(len(tokens), -1)
    return np.packbits(pairs, axis=1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of the set (null without words), and its min-hash tokens."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in word_batches(batch.column(1)):
                values, bounds = distinct(*shingles(words), last - first)
                full = np.flatnonzero(np.diff(bounds))
                prints: list[bytes | None] = [None] * (last - first)
                tokens: list[bytes | None] = [None] * (last - first)
                if len(full):
                    starts = bounds[full]
                    ends = np.append(starts, len(values))
                    a = mix(np.add.reduceat(mix(values), starts) + np.diff(ends).astype(np.uint64))
                    b = np.add.reduceat(mix(values ^ U(0xA5A5A5A5A5A5A5A5)), starts)
                    hashes = _min_hashes(values, ends)
                    for row, x, y, t in zip(full.tolist(), a, b, hashes):
                        prints[row] = x.tobytes() + y.tobytes()
                        tokens[row] = t.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(prints, pa.binary()), pa.array(tokens, pa.binary())], ["doc_id", "print", "tokens"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, print binary, tokens binary")


def _children(row: np.ndarray, node: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The next level: ``(row, node)`` of every picked token of every node."""
    one = (mix(node ^ U(0x5851F42D4C957F2D)) % U(TOKENS)).astype(np.int64)
    step = (mix(node ^ U(0x14057B7EF767814F)) % U(TOKENS - 1)).astype(np.int64) + 1
    twice = mix(node ^ U(0x2545F4914F6CDD1D)) / 2.0**64 < 1 / threshold - 1
    picked = np.concatenate([one, ((one + step) % TOKENS)[twice]])
    row, node = np.concatenate([row, row[twice]]), np.concatenate([node, node[twice]])
    return row, mix(node * U(0xD1342543DE82EF95) + tokens[row, picked].astype(np.uint64) * U(TOKENS) + picked.astype(np.uint64) + U(1))


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


_LEAVES = "node long, rep long, sketch binary"


def _batch(row: np.ndarray, node: np.ndarray, reps: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    sketch = _sketch(tokens)
    data = pa.py_buffer(np.ascontiguousarray(sketch[row]))
    width = pa.array(np.arange(len(row) + 1, dtype=np.int32) * sketch.shape[1])
    column = pa.Array.from_buffers(pa.binary(), len(row), [None, width.buffers()[1], data])
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(reps[row]), column], ["node", "rep", "sketch"])


def _start(sets: DataFrame, number: int, threshold: float) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = _matrix(part.column(1), np.uint32, TOKENS)
                row = np.tile(np.arange(len(tokens)), number)
                node = mix(np.repeat(np.arange(number, dtype=np.uint64), len(tokens)) + U(1))
                for _ in range(DEPTH):
                    row, node = _children(row, node, tokens, threshold)
                yield _batch(row, node, part.column(0).to_numpy(), tokens)

    return sets.select("rep", "tokens").mapInArrow(walk, _LEAVES)


def _deeper(nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column(2), np.uint32, TOKENS)
            row, node = _children(np.arange(len(tokens)), batch.column(0).to_numpy().view(np.uint64), tokens, threshold)
            yield _batch(row, node, batch.column(1).to_numpy(), tokens)

    return nodes.select("node", "rep").join(sets.select("rep", "tokens"), "rep").select("node", "rep", "tokens").mapInArrow(walk, _LEAVES)


def _loose(threshold: float):
    """Links of each leaf's loosely similar sets to the smallest set they reach."""
    least = _least(threshold)

    def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        unequal = a ^ b
        either = (unequal >> U(1) | unequal) & U(0x5555555555555555)
        return TOKENS - np.bitwise_count(either).sum(-1, dtype=np.int64) >= least

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        reps, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        bits = _matrix(table.column("sketch").combine_chunks(), np.uint64, TOKENS // 32)
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        two = two[similar(bits[two], bits[two + 1])]
        a, b = [reps[two]], [reps[two + 1]]
        for start, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            part = bits[start : start + n]
            left, right = [], []
            for at in range(0, n, 256):
                x, y = np.nonzero(similar(part[at : at + 256, None, :], part[None, at:, :]))
                left.append(x + at)
                right.append(y + at)
            low, high = forest(own[start : start + n], np.concatenate(left), np.concatenate(right))
            a.append(reps[start + high])
            b.append(reps[start + low])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return compare


def candidates(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Edges ``(a, b)`` that join loosely similar sets, found by chosen paths."""
    found = []
    leaves = _start(sets, runs(threshold, recall), threshold)
    for depth in range(DEPTH, DEEPEST + 1):
        sizes = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stage(leaves.join(sizes, "node"))
        last = depth == DEEPEST
        small = shared if last else shared.where(F.col("n") <= LEAF)
        found.append(map_groups(blocked(small, "node", "n", "rep", LEAF_BLOCK), ["node", "lo", "hi"], _loose(threshold), "a long, b long", "rep"))
        large = shared.where(F.col("n") > LEAF)
        if last or large.isEmpty():
            break
        leaves = _deeper(large, sets, threshold)
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges.where("a <> b")


def _exact(threshold: float):
    """Links of every set of a pair of blocks, weighted by copies, and the smallest set it reaches."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        reps, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        sets = table.column("set").to_pylist()
        out: list[np.ndarray] = []
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            # Repeated rows of a document come once.
            _, pick = np.unique(reps[start:stop], return_index=True)
            pick = pick + start
            n = len(pick)
            if n < 2:
                continue
            parts = [np.frombuffer(sets[i], np.uint64) for i in pick]
            size = np.array([len(p) for p in parts])
            shared = _overlaps(parts, size)
            near = (shared >= threshold * (size[:, None] + size[None, :] - shared)) & (shared > 0)
            np.fill_diagonal(near, False)
            root = np.arange(n)
            low, high = forest(own[pick], *np.nonzero(near))
            root[high] = low
            if own[start:stop].min() != own[start:stop].max():
                near &= own[pick][:, None] != own[pick][None, :]
            out.append(np.stack([reps[pick], near @ copies[pick], reps[pick][root]]))
        if out:
            rows = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["a", "links", "b"])

    return compare


def _overlaps(parts: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays."""
    n = len(parts)
    if n == 2:
        both = np.concatenate(parts)
        both.sort()
        hit = int((both[1:] == both[:-1]).sum())
        return np.array([[size[0], hit], [hit, size[1]]])
    values = np.concatenate(parts)
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    token = np.cumsum(fresh) - 1
    often = np.bincount(token)[token] > 1  # a shingle of one set alone adds to no intersection
    fresh = fresh & often
    token = (np.cumsum(fresh) - 1)[often]
    row = np.repeat(np.arange(n), size)[order][often]
    total = np.zeros((n, n))
    width = max(256, (1 << 22) // n)
    edges = np.searchsorted(token, np.arange(0, (token[-1] + 1 if len(token) else 0) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b > a:
            wide = np.zeros((n, width), np.float32)
            wide[row[a:b], token[a:b] - k * width] = 1
            total += wide @ wide.T
    shared = total.astype(np.int64)
    np.fill_diagonal(shared, size)
    return shared


def _sets(docs: DataFrame) -> DataFrame:
    """The shingle sets of documents, as sorted 64-bit values."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in word_batches(batch.column(1)):
                values, bounds = distinct(*shingles(words), last - first)
                cuts = bounds.tolist()
                sets = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                rest = [batch.column(k).slice(first, last - first) for k in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], ["rep", "component", "n", "copies", "set"])

    return docs.select("rep", "text", "component", "n", "copies").mapInArrow(build, "rep long, component long, n long, copies long, set binary")


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id with the same set), n_links (other documents linked
    directly, copies included), component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    signed = stage(signatures(docs))
    sets = stage(
        signed.where("doc_id is not null and print is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("tokens").alias("tokens"))
    )
    loose = stage(components(candidates(sets, threshold, recall)))
    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = loose.join(sizes, "component").join(sets.select(F.col("rep").alias("node"), "copies"), "node")
    members = members.select(F.col("node").alias("rep"), "component", "n", "copies")
    if loose.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep")
    compared = map_groups(blocked(_sets(texts), "component", "n", "rep"), ["component", "lo", "hi"], _exact(threshold), "a long, links long, b long", "rep")
    compared = stage(compared)
    links = compared.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    near = components(compared.select("a", "b").where("a <> b")).withColumnRenamed("node", "rep")
    known = sets.select("print", "rep", "copies").join(links, "rep", "left").join(near, "rep", "left")
    known = known.select("print", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # The document side keeps a hot print's rows apart: an adaptive join splits them.
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(known, "print", "left")
    return rows.select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def without_copies(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents less all but one of each component, with all their columns. Rows with a null doc_id stay; of rows
    that share a doc_id one stays."""
    found = join(docs, threshold, recall).where("doc_id is not null").groupBy("doc_id")
    found = stage(found.agg(F.min("kept").alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1"))
    gone, repeated = found.where("not stays").select("doc_id"), found.where("stays").select("doc_id")
    if found.count() <= BROADCAST_ROWS:
        gone, repeated = F.broadcast(gone), F.broadcast(repeated)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)
