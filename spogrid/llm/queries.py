"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spogrid.llm import bpe, code_search, embedding_dedup, filter_audit, langmix, lattice_lm, license_scan, merkle_manifest, orc_tokens, quality, shingle_join, template_decontam, url_vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), _fold("doc_id", 5) != 0)
    held_out = (_fold("doc_id", 5) == 0).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op2_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "matched", "coverage", "run", "shift")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM e),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.c),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n_of AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN n_of ON a = vec_id"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(
        _table(spark, sf_dir, "documents"), _fold("doc_id", 5) != 1, public_tokenizers.path("piece_bpe_32k.model")
    )


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = _fold("doc_id", 4)
    model = langmix.learn(docs, fold != 2)
    held_out = (fold == 2).alias("held_out")
    return langmix.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "mixture")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


def op8_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocabulary.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(_table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b, c = x.n AND c = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE l.b > r.c),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n_of AS (SELECT a, count(*) AS n_links, min(CASE WHEN same THEN b END) AS other FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(other, doc_id)) AS class_id, component_id, coalesce(n_links, 0) AS n_links, doc_id = component_id AS kept
FROM documents JOIN least ON id = doc_id LEFT JOIN n_of ON a = doc_id"""


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.encode_to_orc(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest.manifest(_table(spark, sf_dir, "documents"), tampered=merkle_manifest.tampered_rows())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_search.nearest(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = (op1_quality, op2_template_decontam, op3_embedding_dedup, op4_byte_bpe, op5_lattice_lm, op6_language_mixture, op7_license_scan, op8_url_vocabulary, op9_shingle_join, op10_orc_tokens, op11_merkle_manifest, op12_code_search, op13_filter_audit)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_template_decontam": template_decontam.sql(), "op3_embedding_dedup": OP3_SQL, "op8_url_vocabulary": url_vocabulary.sql(), "op9_shingle_join": OP9_SQL, "op11_merkle_manifest": merkle_manifest.sql(), "op13_filter_audit": filter_audit.sql()}
