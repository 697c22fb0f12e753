"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch holds changes of documents: an insert carries a count, a delete the count it takes back, a revision both. Each
batch is reduced to signed sums per key and committed under its id by one rename; a batch that is already there is left
alone, so a batch may be replayed after any failure. Totals add up the committed batches, from the last snapshot on.

Defined results: null sources and languages are keys of their own; null counts count as 0; null texts have 0 tokens;
a key whose documents and tokens both come to 0 has no row; repeated rows are separate documents; rows with an unknown
kind raise an error. Columns beside those of ``CHANGES`` are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.bpe import encoder, tokenizer_path
from framestride.llm.text import word_batches
from framestride.session import checkpoint_dir, stage

KEYS = ["source", "lang", "version"]
#: A change: its kind (insert, delete, revise), what was counted before, and what counts now.
CHANGES = ["kind", *(f"old_{c}" for c in (*KEYS, "tokens")), *(f"new_{c}" for c in (*KEYS, "tokens"))]
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals in a folder of the store that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _store(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        store, path = self._store(), self._path(kind)
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return [n.removeprefix("id-") for n in self._names("batches")]

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write rows aside and give them their name in one step; false if the name is taken."""
        store, target = self._store(), self._path(name)
        if store.exists(target):
            return False
        aside = f"pending/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{aside}")
        store.mkdirs(target.getParent())
        # A rename onto a folder that came meanwhile would move the rows into it.
        if store.exists(target) or not store.rename(self._path(aside), target):
            store.delete(self._path(aside), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes to the totals; false if the batch was committed before."""
        name = f"batches/id-{batch}"
        if self._store().exists(self._path(name)):
            return False
        return self._publish(deltas(changes), name)

    def snapshot(self) -> None:
        """Fold the committed batches into one table that names them, so that totals read few files."""
        done = self.batches()
        rows = self.totals().withColumn("batches", F.lit("\n".join(done)))
        marker = self.spark.createDataFrame([(None, None, None, 0, 0, "\n".join(done))], f"{TOTALS}, batches string")
        self._publish(rows.union(marker), f"snapshots/{len(done):012d}-{uuid.uuid4().hex}")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of each source, language and version."""
        parts, folded = [], set()
        snapshots = self._names("snapshots")
        if snapshots:
            last = self.spark.read.parquet(f"{self.folder}/snapshots/{snapshots[-1]}")
            folded = set(last.select("batches").first()[0].split("\n"))
            parts.append(last.drop("batches"))
        paths = [f"{self.folder}/batches/id-{b}" for b in self.batches() if b not in folded]
        if paths:
            parts.append(self.spark.read.schema(TOTALS).parquet(*paths))
        rows = parts[0] if parts else self.spark.createDataFrame([], TOTALS)
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key: what a change takes back and what it adds."""
    known = F.col("kind").isin("insert", "delete", "revise")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("string"))

    def side(prefix: str, sign: int):
        tokens = F.coalesce(F.col(f"{prefix}_tokens"), F.lit(0)).cast("long") * sign
        return F.struct(*(F.col(f"{prefix}_{k}").cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("n_docs"), tokens.alias("n_tokens"))

    added = F.when(kind == "insert", F.array(side("new", 1))).when(kind == "delete", F.array(side("old", -1))).otherwise(F.array(side("old", -1), side("new", 1)))
    return _summed(changes.select(F.explode(added).alias("d")).select("d.*"))


def change(kind: str, rows: DataFrame, old: str | None = None, new: str | None = None, old_tokens: str = "old", new_tokens: str = "new") -> DataFrame:
    """Changes of ``kind`` for rows with source and lang, from one tokenizer version to another."""
    columns = [F.lit(kind).alias("kind")]
    for prefix, version, tokens in (("old", old, old_tokens), ("new", new, new_tokens)):
        there = version is not None
        columns += [
            (F.col(k) if there else F.lit(None)).cast("string").alias(f"{prefix}_{k}") if k != "version" else F.lit(version).cast("string").alias(f"{prefix}_version")
            for k in KEYS
        ]
        columns.append((F.col(tokens) if there else F.lit(None)).cast("long").alias(f"{prefix}_tokens"))
    return rows.select(*columns)


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, and the words and BPE tokens of whole texts."""
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            column = batch.column(3)
            words = np.concatenate([np.zeros(0, np.int64), *(np.diff(w.rows) for _, _, w in word_batches(column))])
            tokens = np.concatenate([np.zeros(0, np.int64), *(c for _, _, _, c in encode.column(column))])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(words), pa.array(tokens)], ["doc_id", "source", "lang", "words", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, lang string, words long, tokens long")


#: Tokenizer versions of the query.
WORDS, BPE = "words/1", "word_bpe_49k/1"


def corpus_rollup(docs: DataFrame, labels: DataFrame, path: str | None = None) -> DataFrame:
    """Totals of a corpus after its history: all documents come in under the word count; those of quality 0 go; the
    rest is counted anew by the BPE tokenizer; toxic documents are emptied. The first and the third batch are replayed."""
    spark = docs.sparkSession
    rollup = TokenRollup(spark, f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("t")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.min("q"), F.lit(1)).alias("quality"), F.coalesce(F.max("t"), F.lit(0)).alias("toxic"))
    rows = stage(counted(docs, path).join(marks, "doc_id", "left").withColumn("none", F.lit(0)))
    good = rows.where("coalesce(quality, 1) <> 0")
    load = change("insert", rows, new=WORDS, new_tokens="words")
    anew = change("revise", good, WORDS, BPE, "words", "tokens")
    rollup.commit("1-load", load)
    rollup.commit("2-quality", change("delete", rows.where("quality = 0"), WORDS, old_tokens="words"))
    rollup.commit("1-load", load)
    rollup.snapshot()
    rollup.commit("3-tokenizer", anew)
    rollup.commit("3-tokenizer", anew)
    rollup.commit("4-toxic", change("revise", good.where("toxic = 1"), BPE, BPE, "tokens", "none"))
    return rollup.totals()
