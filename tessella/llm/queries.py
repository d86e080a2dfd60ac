"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, curriculum, html_text, langid, lexical, lm_score, mtree, packing, quality, secrets, simhash, suffix_dedup, turn_trie

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op4_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    good, bad = (labels.where(F.col("quality") == k).select("doc_id") for k in (1, 0))
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), good, rejected=bad)


def op10_langid_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.classify(docs, model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("node")


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("places", F.lit(0))["position"], 6).alias("position"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op1 SQL can express."""
    return op1_quality_llr(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4 SQL can express."""
    return op4_secret_trigrams(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Query] = {
    "op1_quality_llr": op1_quality_llr,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_secret_trigrams": op4_secret_trigrams,
    "op5_packing": op5_packing,
    "op6_simhash_anchors": op6_simhash_anchors,
    "op7_html_blocks": op7_html_blocks,
    "op8_bpe_trie": op8_bpe_trie,
    "op9_cross_entropy": op9_cross_entropy,
    "op10_langid_centroids": op10_langid_centroids,
    "op11_turn_trie": op11_turn_trie,
    "op12_curriculum_mix": op12_curriculum_mix,
    "op13_ranked_search": op13_ranked_search,
    "quality_base_counts": quality_base_counts,
    "secret_base_counts": secret_base_counts,
}

#: DuckDB SQL for the same rows, where SQL can express them on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op11_turn_trie": turn_trie.ORACLE_SQL,
    "op12_curriculum_mix": curriculum.ORACLE_SQL,
    "op13_ranked_search": lexical.ORACLE_SQL,
    "quality_base_counts": quality.BASE_SQL,
    "secret_base_counts": secrets.BASE_SQL,
}
