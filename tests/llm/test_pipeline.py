
import pytest

import corpus_pipeline
from framestride.llm import language, queries, toxicity
from tests.llm.test_similarity import expected_join
from tests.llm.test_text_tokens import plain_shingles

SF = "/root/testdata/sf0.001"


def test_stages_of_odd_rows(spark, odd, tmp_path):
    """Every stage keeps all columns and takes what the one before wrote."""
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == odd.columns, name
            assert docs.count() <= before.count()
    assert docs.count() > 0


def test_stages_of_nothing(spark, nothing, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = nothing
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        assert docs.collect() == []


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(root / str(k)))
        docs = spark.read.parquet(str(root / str(k)))
        out.append(docs.toPandas())
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas(), out


def test_model_stages_drop_what_the_models_reject(spark, staged):
    docs, (clean, known, *_) = staged
    df = spark.createDataFrame(docs)
    network = toxicity.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = df.where(toxicity.toxicity(df["text"], network) < toxicity.threshold(df["lang"], network))
    assert {r["doc_id"] for r in kept.collect()} == set(clean["doc_id"])
    scores = language.identify(spark.createDataFrame(clean)).toPandas()
    good = scores[(scores["lang_pred"] != "und") & (scores["score"] >= corpus_pipeline.LEAST_SCORE)]
    assert set(good["doc_id"]) == set(known["doc_id"])


def test_copies_and_benchmark_texts_go(spark, staged):
    _, (_, known, single, clean, _) = staged
    rows = list(zip(known["doc_id"], known["text"]))
    component = expected_join(rows)[1]
    assert set(single["doc_id"]) == {i for i, c in component.items() if i == c}
    items = [plain_shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, t in zip(single["doc_id"], single["text"]) if any(len(s & plain_shingles(t)) >= 0.8 * len(s) for s in items if s)}
    assert set(clean["doc_id"]) == set(single["doc_id"]) - held


def test_all_kept_documents_are_packed(staged):
    _, (*_, clean, packed) = staged
    assert set(packed["doc_id"]) == set(clean["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_repeated_rows_leave_one(spark, odd):
    from framestride.llm.jaccard_join import without_copies

    ids = [r["doc_id"] for r in without_copies(odd).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12] and ids.count(None) == 2


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{k}_") for q in queries.QUERIES) for k in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op5_benchmark_decontamination", "op7_ngram_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (got, want))
    assert a.equals(b)


