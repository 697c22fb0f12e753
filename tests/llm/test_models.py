import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framestride.llm import language, toxicity
from framestride.llm.folds import held_out, sampled
from framestride.llm.text import word_batches

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_sample_is_bounded_and_whole_when_small(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "if(id < 30, 'rare', 'often') as label")
    counts = {r["label"]: r["count"] for r in sampled(df, "label", "doc_id", 500).groupBy("label").count().collect()}
    assert counts["rare"] == 30 and 350 < counts["often"] < 650


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    unseen = got[got["held_out"]]
    assert (unseen["lang"] == unseen["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_defined_results(odd, nothing):
    rows = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd).collect()}
    assert {r for r in rows if r[0] in (4, 5, 6)} == {(4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)}
    assert language.identify(odd).count() == 15
    assert language.identify(nothing).collect() == []


def test_language_weights_are_sparse_and_probabilities_calibrated():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(400):
        noise = rng.integers(100, 3000, 20)
        at = np.unique(np.concatenate([noise, [5 if k % 2 else 9]]))
        rows.append(("xx" if k % 2 == (rng.random() < 0.9) else "yy", at, np.full(len(at), 1 / np.sqrt(len(at)))))
    model = language.fit(rows, np.ones(language.BUCKETS))
    assert (model.weights == 0).mean() > 0.9
    assert model.temperature > 0


def test_only_lang_and_text_of_learning_rows_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (language.identify(x).orderBy("doc_id").collect() for x in (docs, changed))
    assert a == b


def marked(spark, n=500):
    """Texts whose bad words come with endless endings, as in inflected languages."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(n):
        text = [f"w{rng.integers(3000)}" for _ in range(rng.integers(20, 60))]
        if k % 4 == 0:
            for at in rng.integers(0, len(text), 3):
                text[at] = ["blorf", "snarg"][at % 2] + f"e{rng.integers(500)}"
        rows.append((k, " ".join(text), ["en", "de", None][k % 3]))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = marked(spark)
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert len(got) == 500 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    unseen = got[got["held_out"]]
    assert (unseen["predicted"] == unseen["toxic"]).mean() > 0.93


def test_toxicity_never_reads_lang_or_held_out_labels(spark):
    docs, labels = marked(spark, 200)
    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [[r["score"] for r in toxicity.score_documents(d, x).orderBy("doc_id").collect()] for d, x in ((docs, labels), (docs.withColumn("lang", F.lit("q")), other))]
    assert scores[0] == scores[1]


def test_toxicity_defined_results(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(odd, labels).collect()} == {0.0}
    assert toxicity.score_documents(odd, labels).count() == 15
    assert toxicity.score_documents(nothing, labels.limit(0)).collect() == []


def test_network_finds_the_largest_response_of_whole_texts():
    network = toxicity.Network()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.uint16) for n in (1, 2, 7, 0, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = network.logits(np.concatenate(texts), bounds)
    for t, z in zip(texts, got):
        x = network.embedding[t].sum(1) if len(t) else np.zeros((0, toxicity.WIDTH))
        best = []
        for w, f, b in zip(toxicity.WINDOWS, network.filters, network.bias):
            padded = np.concatenate([x, np.zeros((w - 1, toxicity.WIDTH))])
            r = np.array([b + sum(padded[i + j] @ f[j] for j in range(w)) for i in range(len(x))])
            best.append(np.maximum(r.max(0), 0) if len(x) else np.zeros(toxicity.FILTERS))
        assert z == pytest.approx(network.intercept + np.concatenate(best) @ network.out, abs=1e-4)


def test_language_steps_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 2)
    rng = np.random.default_rng(8)
    examples = []
    for k in range(10):  # fewer than twelve: all are learned from
        at = np.sort(rng.choice(40, 6, replace=False))
        examples.append(("abc"[k % 3], at, rng.random(6) + 0.1))
    model = language.fit(examples, np.ones(language.BUCKETS))

    z, n = {}, {}

    def weight(f, c):
        zs, penalty = z.get((f, c), 0.0), 0.0 if f == "one" else language.L1
        if abs(zs) <= penalty:
            return 0.0
        return (penalty * (1 if zs > 0 else -1) - zs) / ((language.BETA + n.get((f, c), 0.0) ** 0.5) / language.ALPHA + language.L2)

    order = np.random.default_rng(5).permutation(len(examples))
    for _ in range(2):
        for i in order:
            name, at, x = examples[i]
            row = [*zip(at.tolist(), x.tolist()), ("one", 1.0)]
            w = {(f, c): weight(f, c) for f, _ in row for c in range(3)}
            e = [np.exp(sum(v * w[f, c] for f, v in row)) for c in range(3)]
            for c in range(3):
                error = e[c] / sum(e) - (c == "abc".index(name))
                for f, v in row:
                    g, old = v * error, n.get((f, c), 0.0)
                    sigma = ((old + g * g) ** 0.5 - old**0.5) / language.ALPHA
                    z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                    n[f, c] = old + g * g
    want = np.array([[weight(f, c) for c in range(3)] for f in range(40)])
    np.testing.assert_allclose(model.weights[:40], want, rtol=1e-4, atol=1e-6)
    np.testing.assert_allclose(model.bias, [weight("one", c) for c in range(3)], rtol=1e-4, atol=1e-6)
    assert not model.weights[40:].any() and (want != 0).any()


def test_network_gradients_equal_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rng = np.random.default_rng(2)
    count = min(8, toxicity.BATCH)
    texts = [rng.integers(0, 50, (int(rng.integers(1, 9)), 2)) for _ in range(count)]
    labels = np.arange(count) % 2
    net = toxicity.Network()
    net.embedding = net.embedding.astype(np.float64)
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.bias = [b.astype(np.float64) + 0.05 for b in net.bias]
    net.out = net.out.astype(np.float64)
    ids, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def loss():
        p = 1 / (1 + np.exp(-net.logits(ids, bounds)))
        return -(weight * np.log(np.where(labels == 1, p, 1 - p))).mean() + toxicity.DECAY / 2 * (net.out**2).sum()

    params = [*net.filters, *net.bias, net.out]
    before, slopes = [p.copy() for p in params], []
    for k, p in enumerate(params):
        for spot in rng.choice(p.size, 12):
            old = p.flat[spot]
            p.flat[spot] = old + 1e-5
            up = loss()
            p.flat[spot] = old - 1e-5
            slopes.append((k, spot, (up - loss()) / 2e-5))
            p.flat[spot] = old
    net.fit(texts, labels)  # one batch: the step of each number gives back its gradient
    for k, spot, slope in slopes:
        d = (before[k].flat[spot] - params[k].flat[spot]) / toxicity.RATE
        gradient = d * np.sqrt(1e-3 / (1 - d * d))
        assert abs(gradient - slope) <= 1e-5 + 1e-3 * abs(slope), (k, spot, gradient, slope)
    assert sum(abs(s) > 1e-4 for _, _, s in slopes) > 20


def test_toxicity_learns_from_every_part(spark):
    """A word that is rare among the labelled rows is learned too, whichever part holds its rows."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["table", "river", "green", "walk", "seven"], 12)) + (f" zorg{i % 40}" if i % 4 == 0 else "")) for i in range(1600)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    one, many = toxicity.train(docs, labels), toxicity.train(docs, labels, part=300)
    got = toxicity.score_documents(docs, labels, part=300).join(labels, "doc_id").toPandas()
    unseen = got[got["held_out"]]
    assert (unseen["predicted"] == unseen["toxic"]).mean() > 0.97
    # Every labelled row that is not held out moved the embeddings of its words, in one part or in many.
    assert ((one.seen > 1.1e-3) == (many.seen > 1.1e-3)).mean() > 0.99


def test_toxicity_reads_more_rows_than_a_sample(spark, monkeypatch):
    read = []
    monkeypatch.setattr(toxicity, "fitted", lambda parts, count, share, prior: read.append(parts.select(F.sum(F.size("toxic"))).first()[0]) or toxicity.Network())
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.train(docs, labels)
    assert read == [labels.where(~held_out(F.col("doc_id"))).count()]


def test_toxicity_keeps_a_part_in_small_pieces(spark, monkeypatch):
    """No row holds a whole part, and the pieces of a part give back all its texts, labels and languages."""
    monkeypatch.setattr(toxicity, "PIECE", 64)
    kept = []
    monkeypatch.setattr(toxicity, "fitted", lambda parts, count, share, prior: kept.append((parts, count)) or toxicity.Network())
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 30)), "en" if i % 3 else None) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    toxicity.train(docs, labels, part=50)
    (parts, count), rows = kept[0], [*rows, rows[7]]
    sizes = [sum(r["words"]) for r in parts.collect()]
    assert count > 2 and len(sizes) > 2 * count and max(sizes) <= 64
    got = []
    for texts, toxic, lang in toxicity._parts(iter(parts.orderBy("part").toArrow().to_batches())):
        got += [(texts.some(np.array([k]))[0].tobytes(), int(toxic[k]), lang[k] or "") for k in range(len(toxic))]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~held_out(F.col("doc_id"))).collect()
    (_, _, words), = list(word_batches(pa.array([r["text"] for r in learned])))
    ids, cuts = toxicity.buckets(words), words.rows
    want = [(ids[a:b].tobytes(), int(r["doc_id"] % 4 == 0), r["lang"] or "") for r, a, b in zip(learned, cuts, cuts[1:])]
    assert sorted(got) == sorted(want)


def test_network_scores_texts_alike_alone_and_together(monkeypatch):
    """The largest response of the last text does not reach into the zeros behind it."""
    monkeypatch.setattr(toxicity, "SOME", 200)
    network, rng = toxicity.Network(), np.random.default_rng(3)
    network.bias = [b + 1 for b in network.bias]
    texts = [rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.uint16) for n in (300, 1, 2, 1, 5, 250, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = network.logits(np.concatenate(texts), bounds)
    for t, z in zip(texts, got):
        x = np.concatenate([network.embedding[t].sum(1), np.zeros((2, toxicity.WIDTH))])
        best = [np.max([b + sum(x[i + j] @ f[j] for j in range(w)) for i in range(len(t))], 0) for w, f, b in zip(toxicity.WINDOWS, network.filters, network.bias)]
        assert z == pytest.approx(network.intercept + np.maximum(np.concatenate(best), 0) @ network.out, abs=1e-4)


def test_toxicity_keeps_the_pieces_of_a_part_as_they_came():
    """A part in memory takes the size of its pieces; nothing is copied into one table."""
    table = np.arange(12, dtype=np.uint16).reshape(3, 4)
    rows = [(0, (table + 20 * k).tobytes(), np.array([0, 2, 1, 2], np.uint16).tobytes(), [1, 3], [0, 1], ["en", None]) for k in range(3)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "table", "places", "words", "toxic", "lang"])
    (texts, toxic, _), = toxicity._parts(iter([batch]))
    assert len(texts.pieces) == 3 and not any(a.flags.owndata for piece in texts.pieces for a in piece) and len(toxic) == 6
    ids, bounds = texts.some(np.array([5, 0]))
    assert bounds.tolist() == [0, 3, 4] and ids.tolist() == [*(table[[2, 1, 2]] + 40).tolist(), table[0].tolist()]


def test_toxicity_sends_one_network_from_a_task(spark):
    """Each network of a round has its own tasks, which take several parts and send one average on."""
    parts = spark.range(0, 40, 1, 20)

    def learn(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])

    assert sorted(r["n"] for r in toxicity._each(parts, 20, [learn] * 4, "n long").collect()) == sorted([12, 14, 14] * 4)
    assert toxicity._each(parts, 1, [learn] * 4, "n long").count() == 8  # not all of them in one task
