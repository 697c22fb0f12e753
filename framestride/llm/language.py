"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters counts as a space, and character 1- to 3-grams are hashed into 2**15
buckets. Document frequencies are counted over all documents that may be learned from. The weights are fitted with
follow-the-regularised-leader (per coordinate, with L1 and L2 penalties) on a bounded sample of whole labelled texts, by
default about 1,000 documents of each language; a sixth of the sample sets the temperature of the probabilities.

Defined results: ``und`` with score 0 for a null text, a text without letters, and any text if nothing can be learned.
Null doc_ids are held out and never learned from; rows with a null lang are not learned from; repeated rows are each
predicted. Other columns are not read.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestride.llm.folds import held_out, sampled
from framestride.llm.text import text_slices
from framestride.session import arrow_rows

BITS, SAMPLE = 15, 1000
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.1, 3
UNKNOWN = "und"
SLICE_BYTES = 1 << 18
#: Texts of an Arrow batch.
TEXTS_AT_ONCE = 1024

_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None]]:
    """``(row, n-gram counts)`` of each text; None without letters."""
    for first, _, texts in text_slices(column, SLICE_BYTES):
        texts = [t.lower() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
        joined = "  ".join(texts) + "    "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        seen = np.concatenate([[0], np.cumsum(letter)])
        c = np.where(letter, points, np.uint32(32))
        two = c[:-1] * np.uint32(0x01000193) + c[1:]
        three = two[:-1] * np.uint32(0x01000193) + c[2:]
        shift = np.uint32(32 - BITS)
        grams = [(h ^ h >> np.uint32(15)) * m >> shift for h, m in zip((c, two, three), _MULTIPLY)]
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), (at[1:] - 1).tolist())):
            if seen[b] == seen[a]:
                yield first + k, None
            else:
                yield first + k, np.bincount(np.concatenate([g[a:b] for g in grams]), minlength=BUCKETS)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs; the last number counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, tf in counts(batch.column(0)):
                if tf is not None:
                    total[:-1] += tf > 0
                    total[-1] += 1
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    with arrow_rows(texts.sparkSession, TEXTS_AT_ONCE):
        found = rows.collect()  # at most 2**15 + 1 rows
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def _weighted(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of length 1."""
    at = np.flatnonzero(tf)
    x = np.log1p(tf[at]) * idf[at]
    return at, x / np.sqrt((x * x).sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Weights of the n-gram buckets for each language, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def predict(self, tf: np.ndarray | None) -> tuple[str, float]:
        if tf is None or not self.languages:
            return UNKNOWN, 0.0
        at, x = _weighted(tf, self.idf)
        p = _softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """Follow the regularised leader over ``(language, buckets, values)``, then calibrate on every sixth example."""
    languages = sorted({e[0] for e in examples})
    number = {name: k for k, name in enumerate(languages)}
    n_classes = len(languages)
    z = np.zeros((BUCKETS + 1, n_classes))
    n = np.zeros((BUCKETS + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        l1 = np.where(at == BUCKETS, 0.0, L1)[:, None]  # the intercept is not penalised
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(5).permutation(len(examples))
    learn = [i for k, i in enumerate(order) if k % 6 or len(examples) < 12]
    check = [i for k, i in enumerate(order) if k % 6 == 0]
    for _ in range(EPOCHS):
        for i in learn:
            name, at, x = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[number[name]] -= 1
            g = x[:, None] * error
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squares
    every = weights(np.arange(BUCKETS + 1))
    logits = np.array([x @ every[at] + every[-1] for _, at, x in (examples[i] for i in check)])
    truth = np.array([number[examples[i][0]] for i in check])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return Model(languages, idf, every[:-1].astype(np.float32), every[-1].astype(np.float32), float(grid[int(np.argmin(loss))]))


def train(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from the texts and languages of the documents that are not held out."""
    known = docs.select(F.col("doc_id"), "text", F.col("lang").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    df = document_frequencies(known)
    if not df[-1]:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for doc, lang, at, tf in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None:
                    full = np.zeros(BUCKETS, np.int64)
                    full[np.frombuffer(at, np.uint16)] = np.frombuffer(tf, np.int32)
                    rows.append((doc, lang, *_weighted(full, idf)))
        rows.sort(key=lambda r: (r[0], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1:] for r in rows], idf))], pa.binary())], ["model"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats: list[bytes | None] = []
            tfs: list[bytes | None] = []
            for _, tf in counts(batch.column(1)):
                at = np.flatnonzero(tf) if tf is not None else None
                ats.append(None if at is None else at.astype(np.uint16).tobytes())
                tfs.append(None if at is None else tf[at].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ats, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "lang", "at", "tf"])

    sample = sampled(known, "lang", "doc_id", most).select(F.col("doc_id").cast("long"), "text", "lang")
    sparse = sample.mapInArrow(features, "doc_id long, lang string, at binary, tf binary")
    # The sample is bounded, so one task fits the model.
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        return pickle.loads(sparse.repartition(1).mapInArrow(learn, "model binary").first()["model"])


def predicted(text: Column, model: Model) -> Column:
    """``struct<lang_pred string, score double>`` of whole texts."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = [model.predict(tf) for _, tf in counts(column)]
            yield pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), train(docs, most)).alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
