"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relgen.llm import chat, clusters, decontaminate, html, lines, nearest, neardup, packing, quality, substrings, toxicity, trie, urls


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), urls.example_list(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], own.schema)
    return chat.digest(chat.formatted(own.unionByName(more)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.searched(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_line_dedup, op3_url_filter, op4_html_extraction, op5_decontamination, op6_chat_formatting, op7_toxicity, op8_quality_rules, op9_packing, op10_minhash_near_dedup, op11_prefix_trie, op12_centroid_clustering, op13_nearest_neighbours)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substrings.ORACLE_SQL, "op10_minhash_near_dedup": neardup.ORACLE_SQL, "op11_prefix_trie": trie.ORACLE_SQL, "op12_centroid_clustering": clusters.ORACLE_SQL, "op2_line_dedup": lines.ORACLE_SQL, "op3_url_filter": urls.ORACLE_SQL, "op6_chat_formatting": chat.ORACLE_SQL, "op8_quality_rules": quality.ORACLE_SQL}
