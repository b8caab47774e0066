"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import differencing, exact_dedup, filter_audit, fingerprint, line_dedup, mixing, near_dedup, packing, pii, prefix_trie, quality, sharding, url_filter
from .common import conversations, documents, labels, pages
from .filter_audit_sql import OP12_SQL
from .line_dedup_sql import OP8_SQL
from .mixing_sql import OP9_SQL
from .prefix_trie_sql import OP11_SQL


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(pages(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(conversations(spark, sf_dir)).drop("first_pos", "last_pos")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.pack_windows(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_pii_anchors": op2_pii_anchors,
        "op3_quality_rules": op3_quality_rules,
        "op4_bag_minhash": op4_bag_minhash,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_url_filter": op7_url_filter,
        "op8_line_dedup": op8_line_dedup,
        "op9_source_mixing": op9_source_mixing,
        "op10_sharding": op10_sharding,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_filter_audit": op12_filter_audit,
        "op13_differencing": op13_differencing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_source_mixing": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_audit": OP12_SQL}
