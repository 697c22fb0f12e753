import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framestride.llm import elias_fano, packing
from framestride.llm.bpe import Encoder, tokenizer_path
from framestride.llm.text import distinct, shingles, word_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("abAB 0-'\n.é日"), max_size=60)), max_size=20)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([4, 50, 1 << 20]))
def test_words_and_shingles_equal_plain_python(texts, most):
    seen, names = [], {}
    for first, last, words in word_batches(pa.array(texts, pa.string()), most):
        seen += np.diff(words.rows).tolist()
        hashes, rows = shingles(words)
        values, bounds = distinct(hashes, rows, last - first)
        for k in range(last - first):
            want = plain_shingles(texts[first + k])
            got = values[bounds[k] : bounds[k + 1]].tolist()
            assert len(got) == len(want)
            names.setdefault(frozenset(want), got)
            assert names[frozenset(want)] == got
    assert seen == [len(plain_words(t)) for t in texts]
    assert len({tuple(v) for v in names.values()}) == len(names)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


HARD = ["", " ", "don't I'VE we'll 'september ''s", "İ ΣΑΣ", "<|endoftext|> x", "x́", "½ ² ª 12", "日本", "“a” – b…", "a\x1cb\x00", "\u0085 a b"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst'remvld  \n.,!é1ßÀ–“Σ"), max_size=30), max_size=10))
def test_encoder_equals_the_library(encoder, texts):
    texts = texts + HARD
    ids, counts = encoder.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [encoder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_when_its_table_is_full(encoder, monkeypatch):
    monkeypatch.setattr("framestride.llm.bpe.PIECES", 50)
    texts = [" ".join(f"word{k}x{j}" for j in range(20)) for k in range(30)]
    ids = np.concatenate([encoder.encode([t])[0] for t in texts])
    assert ids.tolist() == [i for t in texts for i in encoder.library.encode(t, add_special_tokens=False).ids]


def test_long_unbroken_runs(encoder):
    rng = np.random.default_rng(5)
    texts = ["before", "".join(np.array(list("ACGT"))[rng.integers(0, 4, 1 << 20)]), "=" * (1 << 20), "a" * (1 << 20), "after, too"]
    ids, counts = encoder.encode(texts)
    assert counts.max() > 0xFFFF
    for got, text in zip(np.split(ids, np.cumsum(counts)[:-1]), texts):
        assert np.array_equal(got, encoder.library.encode(text, add_special_tokens=False).ids)


def test_pieces_split_otherwise_go_through_the_library(encoder, monkeypatch):
    whole = Encoder._pieces

    def joined(self, points, bounds):
        starts, ends, text = whole(self, points, bounds)
        return starts[:1], ends[-1:], text[:1]

    fresh = Encoder(tokenizer_path())
    monkeypatch.setattr(Encoder, "_pieces", joined)
    ids, counts = fresh.encode(["two words", "日本"])
    want = [encoder.library.encode(t, add_special_tokens=False).ids for t in ("two words", "日本")]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_elias_fano_round_trip(values, a, b):
    values = np.sort(np.array(values, np.uint64))
    made = elias_fano.EliasFano.encode(values)
    read = elias_fano.EliasFano.read(made.header(), memoryview(b"".join(made.parts())))
    assert (read.slice(0, len(values)) == values).all()
    a, b = min(a, len(values)), min(max(a, b), len(values))
    assert (read.slice(a, b) == values[a:b]).all()
    assert [read.select(i) for i in range(0, len(values), 97)] == values[::97].tolist()


def test_elias_fano_needs_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1200, 100_000))
    made = elias_fano.EliasFano.encode(ends)
    assert sum(map(len, made.parts())) * 8 / len(ends) < 13  # 2 + log2(600) and the samples, against 64


def expected_ids(rows, end):
    library = Encoder(tokenizer_path()).library
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    return [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in sorted(rows, key=key)]


def test_token_files_read_back(odd, odd_rows, monkeypatch):
    got = elias_fano.token_ids(odd).orderBy("start").collect()
    want, at = [], 0
    for doc, ids in expected_ids(odd_rows, 2):
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_shard_reads_any_range(tmp_path):
    from pyarrow import fs

    parts = [np.arange(k, dtype=np.uint32) for k in (3, 1, 5, 2)]
    names = [None, -7, -7, 2**62]
    store = fs.LocalFileSystem()
    assert elias_fano.write_shard(store, str(tmp_path / "x"), iter([(names, np.array([3, 1, 5, 2]), np.concatenate(parts))]), 2) == (4, 11)
    shard = elias_fano.Shard(store, str(tmp_path / "x"))
    assert shard.doc_ids(0, 4) == names and shard.doc_ids(1, 3) == [-7, -7]
    assert shard.offsets(1, 4).tolist() == [3, 4, 9, 11]
    assert shard.ids(4, 9).tolist() == [0, 1, 2, 3, 4]


def test_token_files_of_nothing(nothing):
    assert elias_fano.token_ids(nothing).collect() == []


def best_fit(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=150), st.integers(30, 70))
def test_plan_equals_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan(counts, capacity)
    bins: dict[int, list] = {}
    for size, n in counts.items():
        rows = plan[plan["length"] == size]
        for rank in range(n):
            row = rows[rows["first"] <= rank].iloc[-1]
            past = rank - row["first"]
            bins.setdefault(row["bin"] + past // row["per_bin"], []).append((row["offset"] + past % row["per_bin"] * size, size))
    for items in bins.values():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(bins) == best_fit(lengths, capacity)


def test_tightest_finds_the_smallest_room():
    tree = packing.Tightest(20)
    for room in (3, 9, 20):
        tree.put(room, True)
    assert [tree.find(x) for x in (1, 3, 4, 9, 10, 20)] == [3, 3, 9, 9, 20, 20]
    tree.put(20, False)
    assert tree.find(10) is None


def test_packing_of_odd_rows(odd, odd_rows):
    got = packing.pack_documents(odd).toPandas()
    want = []
    for doc, ids in expected_ids(odd_rows, 0):
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want.append((doc, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    rows = [tuple(None if v != v else int(v) for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted(rows, key=key) == sorted(want, key=key)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 2048
    assert got["sequence_id"].nunique() == best_fit([r[3] for r in want], 2048)


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).collect() == []


def test_packing_takes_texts_in_small_batches_and_sorts_no_pieces(spark):
    """A task holds a bounded number of whole texts at once, and finds the ranks without sorting the pieces."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["length"])

    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    got = packing.pack(rows, capacity=4096, make=sizes, made="length long")
    assert sum(r["length"] for r in got.collect()) == 3000 and max(r["length"] for r in got.collect()) <= packing.TEXTS_AT_ONCE
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
