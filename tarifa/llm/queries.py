"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, covertree, decontam, exact, pagetext, quality, rans, sharding, simhash, spelling, substring, whitening
from .common import table


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_output(spark, sf_dir):
    return rans.file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op5_chat_formatting(spark, sf_dir):
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op6_html_extraction(spark, sf_dir):
    return pagetext.page_texts(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark, sf_dir):
    return substring.removal_digests(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontam.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_topk_search(spark, sf_dir):
    return covertree.top_scores(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.document_variants(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_quality_classifier, op3_token_output, op4_byte_bpe, op5_chat_formatting, op6_html_extraction, op7_substring_dedup,
    op8_exact_dedup, op9_sharding, op10_decontamination, op11_topk_search, op12_spelling_variants, op13_embedding_whitening,
    pipeline)}

ORACLE = {
    "op5_chat_formatting": chat.SQL,
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
""",
    "op11_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(r.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
}
