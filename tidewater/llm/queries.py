"""The training-data queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (ann, bpe, chat, chat_repair, exact_dedup, langid, merkle, mixing, near_dedup, oracles, packing, secret_scan,
               token_files, token_output)
from .common import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(settle(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn

    return deco


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register("op7_exact_dedup", """
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM norm n JOIN groups g ON n.t = g.t
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register("op2_separator_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from flat token files."""
    return token_files.count_tokens(table(spark, sf_dir, "documents"))


@register("op3_secret_novelty")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all texts: counts, digest of the base spans, all spans."""
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@register("op4_bottom_k_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, four words a shingle."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4)


@register("op6_byte_cnn_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents."""
    return langid.predict_languages(table(spark, sf_dir, "documents"))


@register("op8_training_order")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as permuted fixed-stride shards, read back."""
    return token_output.shard_digest(table(spark, sf_dir, "documents"))


@register("op9_snapshot_collapse", """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) AS digest
  FROM conversations
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, digest
                                       ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, digest)
), whole AS (
  SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS copies FROM placed WHERE position = n - 1 GROUP BY n, prefix
), kept AS (
  SELECT * FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.position < p.n - 1 AND p.position + 1 = w.n AND p.prefix = w.prefix)
)
SELECT k.conv_id, p.position // 64 AS part, k.n AS n_turns, k.copies,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.position) AS rendered
FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, p.position // 64, k.n, k.copies
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations of the log, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


@register("op10_pivotal_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents so that sources meet their target words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op1_prefix_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


@register("op11_structure_repair", oracles.REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and then repaired at least cost."""
    return chat_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


@register("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts they decode to, as digests."""
    return bpe.digest(table(spark, sf_dir, "documents"))


@register("op13_merkle_manifest", oracles.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, held against an altered copy."""
    return merkle.verified_documents(table(spark, sf_dir, "documents"))
