"""Registered queries of the operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm import (
    chat_tree,
    containment,
    elias_fano,
    hard_negatives,
    html,
    jaccard_join,
    language,
    licenses,
    packing,
    repair,
    rollups,
    toxicity,
    vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words and distinct five-word shingles of a table ``source(id, text)``, as the operators define them.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def shingle_sql(name: str, ident: str) -> str:
    return f"""
    SELECT DISTINCT {ident}, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT {ident}, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i
          FROM (SELECT {ident}, {WORDS} AS w FROM {name}))"""


@query(
    "op1_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN c ON c.a = vec_id
    """,
)
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_token_rollups")
def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_rollup(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_id_files")
def op4_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.token_ids(table(spark, sf_dir, "documents"))


@query(
    "op5_benchmark_decontamination",
    f"""
    WITH d AS ({shingle_sql("documents", "doc_id")}), b AS ({shingle_sql("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
    h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
    FROM h JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
    """,
)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_html_main_text")
def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query(
    "op7_ngram_jaccard_join",
    f"""
    WITH RECURSIVE s AS ({shingle_sql("documents", "doc_id")}),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    h AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    p AS (SELECT a, b, h.n = x.n AND h.n = y.n AS same FROM h JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE h.n >= 0.8 * (x.n + y.n - h.n)),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
    l AS (SELECT a, count(*) AS n_links, min(b) FILTER (same) AS first FROM p GROUP BY a)
    SELECT doc_id, coalesce(least(first, doc_id), doc_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
    FROM documents JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id
    """,
)
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: Turns in order, and the escape of control strings, as :mod:`framestride.llm.chat_tree` defines them.
_SAID = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace(regexp_replace({}, '(<)(\\*/s>)', '\1\\\2', 'g'), '(\[)(\\*/?(INST|ROLE)\])', '\1\\\2', 'g')"


@query(
    "op11_chat_prefix_tree",
    f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 17 + length({_ESCAPED.format("role")}) END)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op11_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_tree.read_back(chat_tree.tree(rows.union(spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], rows.schema))))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.other_id AS positive_id,
      row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
      n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
