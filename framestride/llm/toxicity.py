"""Toxicity by a convolutional text classifier trained in NumPy.

A word's embedding is the sum of hashed embeddings of the word and of its first four, five and six bytes. Filters one, two
and three words wide slide over the text, each filter keeps its largest response, and a logistic layer weighs them. Only
the winning windows carry gradients, so training is cheap. The network is fitted on all labelled texts that are not held
out. They are dealt to parts of about ``PART`` rows, kept as pieces of about ``PIECE`` words; in each epoch every part goes on
from the same networks over its rows, and the networks that come out are averaged, an embedding by how much each part moved
it. Cross-fitting over three folds calibrates the score on all these rows, and sets a threshold for each language
with enough rows.

Defined results: null and empty texts get the score of a text without words; with too few
labelled rows of either kind every score is 0. Rows with a null doc_id are held out. A document labelled twice counts as toxic if one label says so.
Repeated rows are each scored. Other columns are not read, and lang sets only which threshold is shown.
"""

from __future__ import annotations

import pickle
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.llm.folds import held_out
from framestride.llm.text import U, Words, slices, text_column, word_batches
from framestride.session import arrow_rows, stage

#: Rows of a part, and the number of labelled rows up to which their ids are broadcast.
PART, BROADCAST = 16_384, 1_000_000
#: Bytes of text of a part, and words of a piece of it (more only where one text has more).
PART_BYTES, PIECE = 1 << 27, 1 << 16
#: Texts and pieces of an Arrow batch.
TEXTS_AT_ONCE, PIECES_AT_ONCE = 1024, 16
BUCKETS, WIDTH, FILTERS, WINDOWS = 1 << 15, 12, 12, (1, 2, 3)
PREFIXES = (None, 4, 5, 6)
#: Zeros after each text, and words of the texts that go together, so that their responses stay in the cache.
GAP, SOME = max(WINDOWS) - 1, 2048
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.05, 1e-4
#: Blocks of embeddings that are averaged in one place, and parts that a task learns from.
BLOCKS, GROUP = 16, 8
#: Folds of the calibration, the grid of thresholds, and the rows of each label that a language's own threshold needs.
CROSS, THRESHOLDS, ENOUGH = 3, (0.3, 0.7, 9), 20


def buckets(words: Words) -> np.ndarray:
    """Bucket numbers of each word: one of the word and one of each prefix."""
    out = np.empty((len(words.starts), len(PREFIXES)), np.uint16)
    for k, most in enumerate(PREFIXES):
        out[:, k] = (words.hashes(most) + U(k)) * U(0x9E3779B97F4A7C15) >> U(64 - 15)
    return out


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bucket numbers, and which of them each row is."""
    key = np.zeros(len(ids), U)
    for c in range(ids.shape[1]):
        key |= ids[:, c].astype(U) << U(16 * c)
    _, first, places = np.unique(key, return_index=True, return_inverse=True)
    return ids[first], places.astype(np.uint32)


def _together(texts: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Groups of neighbouring texts of about ``SOME`` words, at least one text each."""
    cuts = np.flatnonzero(np.diff(bounds[texts] // SOME, prepend=-1))
    return np.split(texts, cuts[1:]) if len(texts) else []


def _kind(table: np.ndarray) -> type:
    """The smallest type that holds places in a table."""
    return np.uint16 if len(table) <= 1 << 16 else np.uint32


class Texts:
    """Texts in pieces, each of which holds its texts as places in a table of its distinct words."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]], words: list[np.ndarray]):
        self.pieces, self.lengths = pieces, np.concatenate(words)
        self.piece = np.repeat(np.arange(len(words)), [len(w) for w in words])
        self.first = np.concatenate([np.cumsum(w) - w for w in words])

    def some(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers of the words of the texts picked, and the bounds of these texts."""
        found = []
        for piece, first, length in zip(self.piece[pick].tolist(), self.first[pick].tolist(), self.lengths[pick].tolist()):
            table, places = self.pieces[piece]
            found.append(np.take(table, places[first : first + length], axis=0))
        return np.concatenate(found), np.concatenate([[0], np.cumsum(self.lengths[pick])])


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * WIDTH), (w, WIDTH, FILTERS)).astype(np.float32) for w in WINDOWS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WINDOWS]
        self.out = rng.normal(0, 0.3, len(WINDOWS) * FILTERS).astype(np.float32)
        self.intercept = 0.0
        self.scale, self.shift = 1.0, 0.0
        self.trained = False
        self.thresholds: dict[str | None, float] = {}
        # Squared gradients of the steps so far.
        self.squares = [np.full_like(p, 1e-3) for p in (*self.filters, *self.bias, self.out)]
        self.seen = np.full((BUCKETS, 1), 1e-3, np.float32)
        self.intercept_seen = 1e-3

    def responses(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of all words, each text followed by ``GAP`` zeros, all filters' responses without bias, and the texts' starts."""
        x = np.take(self.embedding, ids[:, 0], axis=0)
        for k in range(1, ids.shape[1]):
            x += np.take(self.embedding, ids[:, k], axis=0)
        starts = bounds + GAP * np.arange(len(bounds))
        padded = np.zeros((starts[-1], WIDTH), x.dtype)
        padded[np.arange(len(x)) + np.repeat(GAP * np.arange(len(bounds) - 1), np.diff(bounds))] = x
        # Row block j holds the words j places further on, so that one product gives the filters of all widths.
        words = np.zeros((len(WINDOWS) * WIDTH, len(padded)), x.dtype)
        words[:WIDTH] = padded.T
        filters = np.zeros((len(WINDOWS) * FILTERS, len(words)), x.dtype)
        for j in range(len(WINDOWS)):
            words[j * WIDTH : (j + 1) * WIDTH, : len(padded) - j] = words[:WIDTH, j:]
            for k, f in enumerate(self.filters):
                if j < len(f):
                    filters[k * FILTERS : (k + 1) * FILTERS, j * WIDTH : (j + 1) * WIDTH] = f[j].T
        return padded, filters @ words, starts

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.full(len(bounds) - 1, self.intercept)
        full = np.flatnonzero(np.diff(bounds))
        for some in _together(full, bounds):
            a, b = bounds[some[0]], bounds[some[-1] + 1]
            _, made, starts = self.responses(ids[a:b], np.append(bounds[some], b) - a)
            ends = np.stack([starts[:-1], starts[1:] - GAP], axis=1).ravel()
            best = np.maximum.reduceat(made[:, : ends[-1]], ends[:-1], axis=1)[:, ::2].T + np.concatenate(self.bias)
            out[some] += np.maximum(best, 0) @ self.out
        return out

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ids, bounds) + self.shift, -60, 60)))

    def _best(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text and filter the largest response, the words from there on, their bucket numbers, and how many are left."""
        padded, made, starts = self.responses(ids, bounds)
        ends = starts[1:] - GAP
        spots = np.stack([made[:, a:b].argmax(1) + a for a, b in zip(starts, ends)])
        left, on = ends[:, None] - spots, np.arange(GAP + 1)
        words = (spots - GAP * np.arange(len(ends))[:, None])[:, :, None] + np.where(on < left[:, :, None], on, 0)
        return made[np.arange(len(made)), spots] + np.concatenate(self.bias), padded[spots[:, :, None] + on], ids[words], left

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 9) -> None:
        """AdaGrad over small batches of texts."""
        rng = np.random.default_rng(seed)
        known = Texts([_distinct(np.concatenate(texts))], [np.array([len(t) for t in texts])])
        for _ in range(EPOCHS):
            self.epoch(known, np.arange(len(labels)), labels, labels.mean(), rng)
        self.trained = True

    def epoch(self, texts: Texts, rows: np.ndarray, labels: np.ndarray, share: float, rng: np.random.Generator) -> None:
        """One pass over the given rows of the texts, in which both labels weigh the same at the given share of toxic rows."""
        squares, seen = self.squares, self.seen
        labels, lengths = labels[rows], texts.lengths[rows]
        weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        there, place = np.zeros(BUCKETS, bool), np.empty(BUCKETS, np.intp)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            pick = pick[lengths[pick] > 0]
            if not len(pick):
                continue
            ids, bounds = texts.some(rows[pick])
            best, near, moved, left = zip(*[self._best(ids[bounds[t[0]] : bounds[t[-1] + 1]], bounds[t[0] : t[-1] + 2] - bounds[t[0]]) for t in _together(np.arange(len(pick)), bounds)])
            best, near, moved, left = (np.concatenate(v) for v in (best, near, moved, left))
            pooled = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.intercept, -30, 30)))
            error = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grads = [np.zeros_like(g) for g in squares]
            grads[-1] += pooled.T @ error + DECAY * self.out
            back = error[:, None] * self.out * (best > 0)
            at: list[np.ndarray] = []
            moves: list[np.ndarray] = []
            for k, width in enumerate(WINDOWS):
                of = slice(k * FILTERS, (k + 1) * FILTERS)
                grads[len(WINDOWS) + k] += back[:, of].sum(0)
                for j in range(width):
                    gj = np.where(left[:, of] > j, back[:, of], 0)
                    grads[k][j] += np.einsum("bf,bfe->ef", gj, near[:, of, j])
                    at.append(moved[:, of, j].reshape(-1, ids.shape[1]))
                    moves.append((gj[:, :, None] * self.filters[k][j].T[None]).reshape(-1, WIDTH))
            moved, move = np.concatenate(at), np.concatenate(moves)
            for p_, g, s in zip((*self.filters, *self.bias, self.out), grads, squares):
                s += g * g
                p_ -= RATE * g / np.sqrt(s)
            step = float(error.sum())
            self.intercept_seen += step * step
            self.intercept -= RATE * step / np.sqrt(self.intercept_seen)
            for c in range(ids.shape[1]):
                there[moved[:, c]] = True
                touched = np.flatnonzero(there)
                there[touched] = False
                place[touched] = np.arange(len(touched))
                total = np.zeros((len(touched), WIDTH), np.float32)
                np.add.at(total.ravel(), (place[moved[:, c], None] * WIDTH + np.arange(WIDTH)).ravel(), move.ravel())
                seen[touched] += (total * total).mean(1, keepdims=True)
                self.embedding[touched] -= RATE * total / np.sqrt(seen[touched])

    def dense(self) -> np.ndarray:
        """All numbers but the embeddings, with their squared gradients."""
        parts = [*self.filters, *self.bias, self.out, *self.squares]
        return np.concatenate([*[p.ravel() for p in parts], [self.intercept, self.intercept_seen]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for p in (*self.filters, *self.bias, self.out, *self.squares):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        self.intercept, self.intercept_seen = float(values[at]), float(values[at + 1])

    def calibrate(self, scored: DataFrame, prior: float) -> None:
        """Scale and shift the logits to probabilities at the given share of toxic rows; thresholds by language.

        ``scored``: ``z``, ``toxic`` and ``lang`` of each row; only sums come to the driver.
        """
        n, good = scored.agg(F.count(F.lit(1)), F.avg("toxic")).first()
        z, y = F.col("z"), F.col("toxic")
        weight = F.when(y == 1, F.lit(prior / good)).otherwise(F.lit((1 - prior) / (1 - good)))

        def chance(a: float, b: float, most: float) -> Column:
            return 1 / (1 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), z * F.lit(a) + F.lit(b)))))

        a, b = 1.0, float(np.log(prior / (1 - prior)))
        for _ in range(100):  # Newton steps of a two-parameter logistic fit, damped by a small penalty
            p = chance(a, b, 30.0)
            v = weight * p * (1 - p) + F.lit(1e-9)
            gz, g1, vzz, vz, v1 = scored.agg(*[F.sum(c) for c in (weight * (p - y) * z, weight * (p - y), v * z * z, v * z, v)]).first()
            step = np.clip(np.linalg.solve([[vzz + 0.1, vz], [vz, v1]], [gz + 0.1 * a, g1]), -1, 1)
            a, b = a - float(step[0]), b - float(step[1])
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = max(a, 0.0), b
        self.thresholds[None] = 0.5
        grid = sorted(np.linspace(*THRESHOLDS).round(3).tolist(), key=lambda t: abs(t - 0.5))
        over = [chance(self.scale, self.shift, 60.0) >= F.lit(t) for t in grid]
        sums = [F.sum(F.when(o, c).otherwise(F.lit(0.0))) for o in over for c in (weight * y, weight)]
        known = scored.where(F.col("lang").isNotNull()).groupBy("lang")
        for row in known.agg(F.sum("toxic"), F.sum(1 - y), F.sum(weight * y), *sums).collect():
            name, toxic, other, good = row[:4]
            if min(toxic, other) >= ENOUGH:
                f1 = [2 * hit / (shown + good) for hit, shown in zip(row[4::2], row[5::2])]
                self.thresholds[name] = float(grid[int(np.argmax(f1))])  # the first best: nearest to 0.5


def _cross_folds(labels: np.ndarray) -> np.ndarray:
    fold = np.empty(len(labels), np.int64)
    for value in (0, 1):
        of = np.flatnonzero(labels == value)
        fold[np.random.default_rng(value).permutation(of)] = np.arange(len(of)) % CROSS
    return fold


def _runs(values: list, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Ranges of equal values between two rows."""
    cuts = [first, *[k for k in range(first + 1, last) if values[k] != values[k - 1]], last]
    return zip(cuts, cuts[1:])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Texts, np.ndarray, list[str | None]]]:
    """Texts, labels and languages of each part whose pieces arrive one after the other."""
    part, pieces = None, []

    def whole() -> tuple[Texts, np.ndarray, list[str | None]]:
        # The pieces stay as they came: one table of a whole part would take ten times their size for a while.
        tables, found, words, toxic, lang = zip(*pieces)
        return Texts(list(zip(tables, found)), list(words)), np.concatenate(toxic), [v for some in lang for v in some]

    for batch in batches:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for row in range(batch.num_rows):
            if pieces and column["part"][row].as_py() != part:
                yield whole()
                pieces = []
            part = column["part"][row].as_py()
            table = np.frombuffer(column["table"][row].as_buffer(), np.uint16).reshape(-1, len(PREFIXES))
            places = np.frombuffer(column["places"][row].as_buffer(), _kind(table))
            numbers = [column[c][row].values.to_numpy().astype(np.int64) for c in ("words", "toxic")]
            pieces.append((table, places, *numbers, column["lang"][row].values.to_pylist()))
    if pieces:
        yield whole()


def _each(parts: DataFrame, count: int, learners: list, schema: str) -> DataFrame:
    """What each learner makes of all parts, in a task of its own for each group of them."""
    # Two groups at least: a union of single partitions would put all learners into one task.
    grouped = parts.coalesce(max(2, math.ceil(count / GROUP)))
    return reduce(DataFrame.union, [grouped.mapInArrow(learn, schema) for learn in learners])


def _averaged(parts: DataFrame, count: int, networks: list[Network], share: float, done: int, epochs: int) -> None:
    """Every part goes on from the networks over its rows; then each network is the average of those that came out.

    Network k leaves out fold k; the last one takes all rows. A task takes one network over up to ``GROUP`` parts, one after the
    other, and sends only their average on, so that a round moves one network per task and not four per part.
    """
    size, numbers = BUCKETS // BLOCKS, networks[0].dense().size
    held = parts.sparkSession.sparkContext.broadcast(networks)

    def learner(k: int):
        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, rows = held.value[k], 0
            total, weights = np.zeros((BUCKETS, WIDTH + 1)), np.zeros(BUCKETS)
            dense = np.zeros(numbers)
            for texts, labels, _ in _parts(batches):
                network = pickle.loads(pickle.dumps(start))
                mine = np.flatnonzero(_cross_folds(labels) != k)
                rng = np.random.default_rng([9, done])
                for _ in range(epochs):
                    network.epoch(texts, mine, labels, share, rng)
                moved = (network.seen - start.seen)[:, 0].astype(np.float64)
                total[:, :WIDTH] += moved[:, None] * network.embedding
                total[:, WIDTH] += moved * network.seen[:, 0]
                weights += moved
                dense += len(mine) * network.dense()
                rows += len(mine)
            if not rows:
                return
            out = [(k, -1, b"", np.full(1, rows, np.float64).tobytes(), (dense / rows).tobytes())]
            for n in range(BLOCKS):
                at = np.flatnonzero(weights[n * size : (n + 1) * size])
                if len(at):
                    of = n * size + at
                    mean = (total[of] / weights[of, None]).astype(np.float32)
                    out.append((k, n, at.astype(np.uint16).tobytes(), weights[of].tobytes(), mean.tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["network", "block", "at", "weight", "rows"])

        return learn

    def average(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        kind, width, n = (np.float64, numbers, 1) if block < 0 else (np.float32, WIDTH + 1, size)
        total, weights = np.zeros((n, width)), np.zeros((n, 1))
        for at, weight, rows in zip(table.column("at"), table.column("weight"), table.column("rows")):
            at = np.frombuffer(at.as_buffer(), np.uint16) if block >= 0 else slice(None)
            w = np.frombuffer(weight.as_buffer(), np.float64)[:, None]
            total[at] += w * np.frombuffer(rows.as_buffer(), kind).reshape(-1, width)
            weights[at] += w
        at = np.flatnonzero(weights[:, 0] > 0)
        mean = (total[at] / weights[at]).astype(kind).tobytes()
        columns = [table.column("network")[:1], table.column("block")[:1], pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([mean], pa.binary())]
        return pa.table(columns, names=["network", "block", "at", "rows"])

    made = _each(parts, count, [learner(k) for k in range(len(networks))], "network int, block int, at binary, weight binary, rows binary")
    with arrow_rows(parts.sparkSession, PIECES_AT_ONCE):
        rounds = made.groupBy("network", "block").applyInArrow(average, "network int, block int, at binary, rows binary").collect()
    for row in rounds:
        network = networks[row["network"]]
        if row["block"] < 0:
            network.set_dense(np.frombuffer(row["rows"], np.float64))
        else:
            at = row["block"] * size + np.frombuffer(row["at"], np.uint16).astype(np.int64)
            rows = np.frombuffer(row["rows"], np.float32).reshape(-1, WIDTH + 1)
            network.embedding[at], network.seen[at] = rows[:, :WIDTH], rows[:, WIDTH:]
    held.destroy()  # or every round would leave its networks on all disks


def fitted(parts: DataFrame, count: int, share: float, prior: float) -> Network:
    """A network of all rows, calibrated by the logits that networks of the other folds give each row."""
    networks = [Network() for _ in range(CROSS + 1)]
    epochs = EPOCHS if count == 1 else 1
    for done in range(0, EPOCHS, epochs):
        _averaged(parts, count, networks, share, done, epochs)

    held = parts.sparkSession.sparkContext.broadcast(networks)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, labels, lang in _parts(batches):
            fold, z = _cross_folds(labels), np.empty(len(labels))
            for k in range(CROSS):
                mine = np.flatnonzero(fold == k)
                for at in range(0, len(mine), 256):
                    some = mine[at : at + 256]
                    z[some] = held.value[k].logits(*texts.some(some))
            for at in range(0, len(z), 10_000):
                some = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(z[some]), pa.array(labels[some], pa.int32()), pa.array(lang[some], pa.string())], ["z", "toxic", "lang"])

    with arrow_rows(parts.sparkSession, PIECES_AT_ONCE):
        scored = stage(parts.mapInArrow(judge, "z double, toxic int, lang string"))
    held.destroy()
    networks[-1].trained = True
    networks[-1].calibrate(scored, prior)
    return networks[-1]


def train(docs: DataFrame, labels: DataFrame, part: int = PART) -> Network:
    """Fit on all labelled documents that are not held out, in parts of about ``part`` rows."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows, prior = marked.agg(F.count(F.lit(1)), F.avg("toxic")).first()
    if prior in (None, 0.0, 1.0):
        return Network()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    found = found.join(F.broadcast(marked) if rows <= BROADCAST else marked, "doc_id")
    size = found.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(math.ceil(rows / part), math.ceil(size / PART_BYTES))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in word_batches(batch.column(1)):
                ids, cuts = buckets(words), words.rows.tolist()
                rest = [batch.column(k).slice(first, last - first) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "lang", "toxic", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
        names = ["part", "table", "places", "words", "toxic", "lang"]
        for batch in batches:
            column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            of, toxic, lang = (column[c].to_pylist() for c in ("part", "toxic", "lang"))
            ends, data = text_column(column["ids"])
            for first, last in slices(ends, PIECE * 2 * len(PREFIXES)):
                for a, b in _runs(of, first, last):
                    table, places = _distinct(data[ends[a] : ends[b]].view(np.uint16).reshape(-1, len(PREFIXES)))
                    words = np.diff(ends[a : b + 1]) // (2 * len(PREFIXES))
                    row = (of[a], table.tobytes(), places.astype(_kind(table)).tobytes(), words.tolist(), toxic[a:b], lang[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    found = found.select("doc_id", "text", "lang", "toxic").mapInArrow(features, "doc_id long, lang string, toxic int, ids binary")
    # The rows of a part come to one partition and stay in one row group of one file, so that every round reads it in one
    # place without moving it again.
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(count)).cast("int")).repartitionById(count, F.col("part"))
    rows = dealt.sortWithinPartitions("part", "doc_id", "ids").mapInArrow(pieces, "part int, table binary, places binary, words array<long>, toxic array<int>, lang array<string>")
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        parts = stage(rows, {"parquet.block.size": 1 << 30})
    size = F.size("toxic")
    n, toxic = parts.agg(F.sum(size), F.sum(F.aggregate("toxic", F.lit(0), lambda s, x: s + x))).first()
    if n is None or min(toxic, n - toxic) < 2 * CROSS:
        return Network()
    return fitted(parts, count, toxic / n, prior)


def toxicity(text: Column, network: Network) -> Column:
    """The score of whole texts, 0 to 1."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.zeros(len(column))
            for first, last, words in word_batches(column):
                out[first:last] = network.scores(buckets(words), words.rows)
            yield pa.array(out)

    return score(text)


def threshold(lang: Column, network: Network) -> Column:
    """The threshold of a document's language; the common one where the language is null or unknown."""
    found = F.lit(network.thresholds.get(None, 0.5))
    for name, value in network.thresholds.items():
        if name is not None:
            found = F.when(lang == F.lit(name), F.lit(value)).otherwise(found)
    return found


def score_documents(docs: DataFrame, labels: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, held_out, score, predicted, and the language's threshold with its decision."""
    network = train(docs, labels, part)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), network).alias("score"), threshold(F.col("lang"), network).alias("threshold"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
