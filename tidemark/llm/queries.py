"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from tidemark.llm.common import table
from tidemark.llm.decontaminate import contamination
from tidemark.llm.divergence import source_divergence
from tidemark.llm.lm import lm_scores
from tidemark.llm.merkle import manifest_check
from tidemark.llm.mixing import mix
from tidemark.llm.quality import quality_rules
from tidemark.llm.queries_sql import DIVERGENCE_SQL, merkle_sql
from tidemark.llm.secrets import find_secrets
from tidemark.llm.sharding import shard_by_bytes
from tidemark.llm.simhash import simhash_components
from tidemark.llm.suffixes import duplicate_spans
from tidemark.llm.token_counts import token_counts
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import toxicity


def op1_suffix_dedup(spark, sf_dir):
    return duplicate_spans(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    return manifest_check(table(spark, sf_dir, "documents"))


def op12_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_quality(spark, sf_dir):
    rows, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_decontaminate, op4_simhash, op5_mixing, op6_lm_scores, op7_toxicity, op8_sharding, op9_topk, op10_secrets, op11_merkle, op12_divergence, op13_quality)}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle": merkle_sql(),
    "op12_divergence": DIVERGENCE_SQL,
    "op9_topk": """
WITH fine AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
