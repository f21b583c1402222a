"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm import alignment, bpe, chat, html, jaccard, licenses, loss_packing, media, packing, quality, sharding, spelling, suffixes, windows


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _packed_chats(conversations: DataFrame) -> DataFrame:
    """Conversations in sequences whose loss-bearing tokens, counted on the masks, are limited, too: here to a quarter of the tokens.

    A conversation is one example, or one a part where it is so long that it is formatted in segments.
    """
    masks = chat.format_chats(conversations).select(F.col("conv_id").alias("id"), F.col("segment").alias("part"), "loss")
    return loss_packing.pack_masked(masks, capacity=2048, max_segments=16, max_loss=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_signature_tree_join": _over("documents", jaccard.op1),
        "op2_quality_line_frequency": _over("documents", quality.op2),
        "op3_license_digests": _over("documents", licenses.op3),
        "op4_chat_loss_masks": _over("conversations", chat.op4),
        "op5_histogram_sort_shards": _over("documents", sharding.op5),
        "op6_interval_tree_dedup": _over("documents", suffixes.dedup_digests),
        "op7_html_tree_scoring": _over("pages", html.extract),
        "op8_telephony_media": _over("documents", media.text_media),
        "op9_word_table_bpe": _over("documents", bpe.encode_decode),
        "op10_vector_bin_packing": _over("documents", packing.pack_documents),
        "op11_deletion_key_variants": _over("documents", spelling.variants),
        "op12_token_alignment": _over("documents", alignment.corpus_links),
        "op13_count_min_windows": _over("documents", windows.dedup_words),
        "chats_packed_by_loss": _over("conversations", _packed_chats),
        "license_variants": _over("documents", licenses.variants),
        "shards_by_bytes": _over("documents", lambda docs: sharding.assign(docs).select("doc_id", "size", "shard", "slot")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_signature_tree_join": jaccard.ORACLE,
        "op2_quality_line_frequency": quality.ORACLE,
        "op3_license_digests": licenses.ORACLE,
        "op4_chat_loss_masks": chat.ORACLE,
        "op6_interval_tree_dedup": suffixes.ORACLE,
        "op13_count_min_windows": windows.ORACLE,
        "license_variants": licenses.VARIANTS_ORACLE,
        "shards_by_bytes": sharding.ORACLE,
    }
