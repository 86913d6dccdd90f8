"""The queries of this folder's operators, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, graph_search, html_text, language_id, line_dedup, near_dedup, pieces, secret_scan, token_counts, token_files, turn_repair, vector_dedup
from .common import tokenizer_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(_documents(spark, sf_dir).select("doc_id", "text")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(50)) == 0)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.visible_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", "text")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_hash")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("n_id").alias("doc_id"), "class_id", "kept", "n_copies")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(spark, _documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.drop("n_exact")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(turn_repair.repairs(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_graph_search, op4_html_text, op5_sentencepiece, op6_decontaminate, op7_near_dedup, op8_token_counts, op9_language_id, op10_token_files, op11_centroid_clusters, op12_turn_repair, op13_vector_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op11_centroid_clusters": centroids.SQL, "op12_turn_repair": turn_repair.SQL, "op13_vector_dedup": vector_dedup.SQL}
