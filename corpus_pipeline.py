"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece round trip, each stage on the one before.

Each stage's result is written as Parquet and read again for the next one, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, language_id, line_dedup, near_dedup, pieces
from quillstone.llm.common import tokenizer_path, written

#: Documents of a calibrated probability below this have no language that the model knows.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null texts, and texts whose language stays below LEAST_SCORE. The model learns from documents as op9 does.

    Rows of null doc_id or lang teach nothing and are judged like others; equal probabilities go to the language that sorts first; rows that repeat stay or go together. Whole texts of any length. Without a row to
    learn from no language is known, so nothing stays; an empty table gives an empty table. Extra columns pass through, whatever their names."""
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))))
    scored = language_id.predict(_packed(docs), model)
    return _unpacked(scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat from earlier ones; a document that had text and has none left goes. n_chars follows the text.

    Of equal windows the first by doc_id (null ids first) and line stays; texts of under three lines lose none; empty texts, and null ones, stay as they are. Whole texts of any length; an empty table gives an empty table; extra columns pass
    through."""
    cut = line_dedup.without_repeated_lines(_packed(docs))
    stays = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\r\n\f\x0B]")
    return _with_length(_unpacked(cut.where(stays), docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: the row of the least doc_id, nulls last, of equal ids the one of the least text hash.

    Rows that repeat id and text are one document. Null texts and texts without words are classes of their own and stay. Whole texts of any length; an empty table gives an empty table; extra columns pass through."""
    return near_dedup.deduplicated(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item.

    Null and empty texts contain none and stay; rows that repeat stay or go together. An item of null id counts, one without words doesn't; an empty benchmark drops nothing. Whole texts of any length; extra columns pass through."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256 and decoded_sha256. A row for each row, repeats and null ids too; null and empty texts have no tokens."""
    return pieces.digests(docs, tokenizer_path("piece_bpe_32k.model"))


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that none is replaced by a column of its name that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*rest).alias("own")] if rest else []))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the columns of docs again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: SQL has neither the classifier, nor signatures, nor tokenizers: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
